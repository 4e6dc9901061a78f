"""Edit logs replayed: typed actions in, the final state of each document out.

An action is a row (doc, seq, type) with the fields of ACTION that its type needs; a log may lack the columns of types
that it never has. What a type does is said in ACTIONS; everything here is plain values, so a snapshot is a reference.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Snapshots that undo and redo keep.
HISTORY = 20
#: The payload of an action. Lines of an edit or field are `line_ids`, its text `value`, as is the new name; `target_id` is
#: the page made or the one moved to; `revision` is the stored one of a restore and the expected one of a field edit.
ACTION = {
    "page_id": "string", "target_id": "string", "delta": "double", "line_ids": "array<string>", "value": "string", "mapping_id": "string", "revision": "bigint",
    "pages": "array<struct<id:string,kind:string,source_page:bigint,original:boolean,rotation:bigint>>",
    "region": "struct<reviewed:boolean,mappings:array<struct<id:string,role:string,page_id:string,source_page:bigint,line_ids:array<string>,text:string>>,selected:array<string>>",
}


@dataclass(frozen=True)
class Page:
    """edits: the (line ids, text) of each edit, in order; blank pages have none."""

    id: str
    kind: str = "pdf"
    source_page: int | None = None
    original: bool = True
    rotation: int = 0
    edits: tuple[tuple[tuple[str, ...], str], ...] = ()


@dataclass(frozen=True)
class Mapping:
    id: str
    role: str
    page_id: str
    source_page: int | None
    line_ids: tuple[str, ...]
    text: str


@dataclass(frozen=True)
class Region:
    reviewed: bool
    mappings: tuple[Mapping, ...]
    selected: tuple[str, ...]


@dataclass(frozen=True)
class Content:
    """What undo brings back."""

    pages: tuple[Page, ...]
    active: str | None
    region: Region | None = None

    def place(self, page: str | None) -> int:
        return next((i for i, p in enumerate(self.pages) if p.id == page), -1)

    def with_page(self, page: Page) -> Content:
        return replace(self, pages=tuple(page if p.id == page.id else p for p in self.pages))

    def unreviewed(self) -> Content:
        return replace(self, region=replace(self.region, reviewed=False, selected=())) if self.region and self.region.reviewed else self


def _pages(rows: list[dict] | None) -> tuple[Page, ...]:
    return tuple(Page(r["id"], r.get("kind", "pdf"), r.get("source_page"), r.get("original", True), r.get("rotation", 0)) for r in rows or ())


def _region(row: dict) -> Region:
    mappings = tuple(Mapping(m["id"], m.get("role", ""), m.get("page_id", ""), m.get("source_page"), tuple(m.get("line_ids", ())), m.get("text", "")) for m in row.get("mappings", ()))
    return Region(row.get("reviewed", False), mappings, tuple(row.get("selected", ())))


# --- actions on content: each gives the content after it, or the same where it has no effect ---


def rotate(c: Content, a: dict) -> Content:
    """Turns a page by a multiple of 90 degrees; other turns are ignored."""
    at, delta = c.place(a.get("page_id")), a.get("delta")
    if at < 0 or not isinstance(delta, (int, float)) or not math.isfinite(delta) or delta % 90:
        return c
    return c.with_page(replace(c.pages[at], rotation=int((c.pages[at].rotation + delta) % 360)))


def duplicate(c: Content, a: dict) -> Content:
    """Puts a copy, with its edits, behind a page and activates it; an id in use is refused."""
    at, new = c.place(a.get("page_id")), a.get("target_id")
    if at < 0 or new is None or c.place(new) >= 0:
        return c
    page = c.pages[at]
    copy = replace(page, id=new, original=False if page.kind == "pdf" else page.original)
    return replace(c, pages=(*c.pages[: at + 1], copy, *c.pages[at + 1 :]), active=new)


def delete(c: Content, a: dict) -> Content:
    """Takes a page out with its mappings, never the last one; the page now at its place, or else the last, is active
    if it was."""
    at = c.place(a.get("page_id"))
    if at < 0 or len(c.pages) < 2:
        return c
    gone, pages, region = c.pages[at].id, c.pages[:at] + c.pages[at + 1 :], c.region
    if region:
        kept = tuple(m for m in region.mappings if m.page_id != gone)
        region = replace(region, mappings=kept, selected=tuple(s for s in region.selected if any(m.id == s for m in kept)))
    return Content(pages, pages[min(at, len(pages) - 1)].id if c.active == gone else c.active, region)


def add(c: Content, a: dict) -> Content:
    """Appends a blank page and activates it; an id in use is refused."""
    new = a.get("target_id")
    return c if new is None or c.place(new) >= 0 else replace(c, pages=(*c.pages, Page(new, "blank", None, False)), active=new)


def reorder(c: Content, a: dict) -> Content:
    """Moves a page to where another one stood before."""
    at, to = c.place(a.get("page_id")), c.place(a.get("target_id"))
    if at < 0 or to < 0 or at == to:
        return c
    rest = c.pages[:at] + c.pages[at + 1 :]
    return replace(c, pages=(*rest[:to], c.pages[at], *rest[to:]))


def edit(c: Content, a: dict) -> Content:
    """Sets the text of lines of a page in place of the edits that they cover, at the first of them. Refused where an
    edit shares some of its lines only, where lines are none, empty or repeat, and on blank pages."""
    at, lines = c.place(a.get("page_id")), tuple(a.get("line_ids", ()))
    if at < 0 or c.pages[at].kind != "pdf" or not lines or not all(lines) or len(set(lines)) < len(lines):
        return c
    page, own = c.pages[at], set(lines)
    hit = [k for k, (held, _) in enumerate(page.edits) if own & set(held)]
    if any(set(page.edits[k][0]) - own for k in hit):
        return c
    first = hit[0] if hit else len(page.edits)
    rest = [e for k, e in enumerate(page.edits) if k not in hit]
    return c.with_page(replace(page, edits=(*rest[:first], (lines, a.get("value", "")), *rest[first:])))


def remove(c: Content, a: dict) -> Content:
    """Drops the whole edit that holds one of the lines."""
    at, lines = c.place(a.get("page_id")), set(a.get("line_ids", ()))
    if at < 0:
        return c
    return c.with_page(replace(c.pages[at], edits=tuple(e for e in c.pages[at].edits if not lines & set(e[0]))))


def field(c: Content, a: dict) -> Content:
    """A guarded edit of the lines of a mapping, which keeps the review. Refused unless the region is reviewed, the
    mapping isn't locked and is anchored to just these lines of this page, and no locked one shares a line."""
    at = c.place(a.get("page_id"))
    mapping = next((m for m in c.region.mappings if m.id == a.get("mapping_id")), None) if c.region and c.region.reviewed else None
    if at < 0 or mapping is None or mapping.role == "locked":
        return c
    page, lines = c.pages[at], tuple(a.get("line_ids", ()))
    if (mapping.page_id, mapping.source_page, mapping.line_ids) != (page.id, page.source_page, lines):
        return c
    if any(m.role == "locked" and m.page_id == page.id and set(m.line_ids) & set(lines) for m in c.region.mappings):
        return c
    edited = edit(c, a)
    if edited == c:
        return c
    text = replace(mapping, text=a.get("value", ""))
    return replace(edited, region=replace(c.region, mappings=tuple(text if m.id == mapping.id else m for m in c.region.mappings)))


ACTIONS: dict[str, Callable[[Content, dict], Content]] = {f.__name__: f for f in (rotate, duplicate, delete, add, reorder, edit, remove, field)}


@dataclass
class Document:
    """A document while its log is replayed; content is None before the first load."""

    content: Content | None = None
    name: str = ""
    revision: int = 0
    undo: tuple[Content, ...] = ()
    redo: tuple[Content, ...] = ()

    def apply(self, a: dict) -> None:
        kind = a["type"]
        if kind in ("load", "restore"):  # another document under this id; its history begins anew
            pages = _pages(a.get("pages"))
            region = _region(a["region"]) if a.get("region") else None
            self.content = Content(pages, pages[0].id if pages else None, region)
            self.revision = max(self.revision, a.get("revision", 0) if kind == "restore" else 0) + 1
            self.name, self.undo, self.redo = a.get("value", ""), (), ()
        elif self.content is None:
            return
        elif kind == "rename":
            self.name = a.get("value", "")
        elif kind == "activate":
            page = a.get("page_id")
            if page != self.content.active and self.content.place(page) >= 0:
                self.content, self.revision = replace(self.content, active=page), self.revision + 1
        elif kind == "region":
            new, old = _region(a.get("region", {})), self.content.region
            if not (old and old.reviewed and new.reviewed and old.mappings != new.mappings):
                self.content = replace(self.content, region=new)
        elif kind in ("undo", "redo"):
            self._step_back(kind == "undo")
        elif kind in ACTIONS and not (kind == "field" and a.get("revision", self.revision) != self.revision):
            after = ACTIONS[kind](self.content, a)
            if after != self.content:
                self.undo, self.redo = (*self.undo, self.content)[-HISTORY:], ()
                self.content = after if kind == "field" else after.unreviewed()
                self.revision += 1

    def _step_back(self, undo: bool) -> None:
        source, target = (self.undo, self.redo) if undo else (self.redo, self.undo)
        if source:
            target = (*target, self.content)[-HISTORY:]
            self.content, self.revision = source[-1].unreviewed(), self.revision + 1
            self.undo, self.redo = (source[:-1], target) if undo else (target, source[:-1])

    def row(self) -> dict:
        """The state in columns of STATE."""
        c = self.content or Content((), None)
        edits = [f"{p.id}={'|'.join('+'.join(lines) + ':' + text for lines, text in p.edits)}" for p in c.pages if p.edits]
        mappings = [f"{m.id}@{m.page_id}{'!' if m.role == 'locked' else ''}={m.text}" for m in (c.region.mappings if c.region else ())]
        return {
            "name": self.name, "revision": self.revision, "active": c.active, "n_pages": len(c.pages), "pages": ",".join(f"{p.id}:{p.rotation}{'' if p.original else '*'}" for p in c.pages), "edits": ";".join(edits), "mappings": ";".join(mappings),
            "selected": ",".join(c.region.selected) if c.region else "", "reviewed": bool(c.region and c.region.reviewed), "n_undo": len(self.undo), "n_redo": len(self.redo),
        }

    def dump(self) -> str:
        """The state as JSON, for a state store."""
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> Document:
        def content(row: dict | None) -> Content | None:
            if row is None:
                return None
            pages = tuple(Page(**{**p, "edits": tuple((tuple(lines), text) for lines, text in p["edits"])}) for p in row["pages"])
            return Content(pages, row["active"], _region(row["region"]) if row["region"] else None)

        held = json.loads(text)
        return cls(content(held["content"]), held["name"], held["revision"], tuple(map(content, held["undo"])), tuple(map(content, held["redo"])))


STATE = "name string, revision bigint, active string, n_pages bigint, pages string, edits string, mappings string, selected string, reviewed boolean, n_undo bigint, n_redo bigint"


def as_json(actions: DataFrame) -> DataFrame:
    """(doc, seq, action): each action with its payload as one JSON text; null fields are left out, and pages and
    regions may lack fields."""
    fields = [F.col(c) if "struct" in kind else F.col(c).cast(kind).alias(c) for c, kind in ACTION.items() if c in actions.columns]
    return actions.select("doc", "seq", F.to_json(F.struct("type", *fields)).alias("action"))


def replay_actions(actions: DataFrame) -> DataFrame:
    """(doc, name, revision, active, n_pages, pages, edits, ...): the final state of each document whose typed
    actions are replayed in order of seq (of equal ones, of their JSON text).

    Loading and restoring begin a new history and raise the revision above the old one and the restored one; before
    the first of them nothing has an effect. Activation raises the revision but leaves history alone; renaming and
    setting the region do neither, and a region may not change its mappings while it is reviewed before and after.
    The actions of ACTIONS that have an effect push a snapshot (the last HISTORY are kept), clear redo and raise the
    revision; they end a review, but for guarded field edits, which may name the revision that they expect. Undo and
    redo move snapshots, raise the revision and end a review. Unknown types have no effect. The log is sorted by Spark
    and passes by in batches, so a document's whole log is never held; what is held is one state.
    """
    rows = as_json(actions).repartition("doc").sortWithinPartitions("doc", "seq", "action")
    key = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, state = None, None
        for batch in batches:
            out = []
            for d, action in zip(batch["doc"], batch["action"]):
                if state is None or d != doc:
                    if state is not None:
                        out.append({"doc": doc, **state.row()})
                    doc, state = d, Document()
                state.apply(json.loads(action))
            if out:
                yield pd.DataFrame(out)
        if state is not None:
            yield pd.DataFrame([{"doc": doc, **state.row()}])

    return rows.where("doc is not null").mapInPandas(run, f"doc {key}, {STATE}")

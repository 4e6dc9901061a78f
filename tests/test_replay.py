"""Typed edit logs: rules one by one, and a second replay that shares no code with the operator, batch and stream."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from quire import relations as R
from quire.operators import replay
from quire.streaming import jobs

LOAD = {"type": "load", "value": "n", "pages": [{"id": p, "source_page": i} for i, p in enumerate("abc")]}


def after(*log, load=LOAD):
    document = replay.Document()
    for a in (load, *log):
        document.apply({"type": a} if isinstance(a, str) else a)
    return document


def act(kind, page=None, target=None, **more):
    return {"type": kind, **({"page_id": page} if page else {}), **({"target_id": target} if target else {}), **more}


def test_turns_other_than_quarters_are_ignored():
    for delta in (45, 0.5, float("nan"), float("inf"), None):
        assert after(act("rotate", "a", delta=delta)).revision == 1
    for delta, want in ((90, 90), (-90, 270), (450, 90), (-1080, 0), (180.0, 180)):
        assert after(act("rotate", "a", delta=delta)).content.pages[0].rotation == want
    assert after(act("rotate", "a", delta=360)).undo == () and after(act("rotate", "z", delta=90)).revision == 1


def test_ids_in_use_are_refused():
    for a in (act("add", target="b"), act("duplicate", "a", "c"), act("add"), act("duplicate", "z", "d")):
        assert after(a).revision == 1
    got = after(act("edit", "a", line_ids=["l"], value="t"), act("duplicate", "a", "d"), act("edit", "d", line_ids=["l"], value="u"))
    assert [(p.id, p.original, p.edits) for p in got.content.pages[:2]] == [("a", True, ((("l",), "t"),)), ("d", False, ((("l",), "u"),))] and got.content.active == "d"


def test_the_last_page_stays_and_a_successor_is_active():
    got = after(act("activate", "b"), act("delete", "b"))
    assert (got.content.active, got.revision, len(got.undo)) == ("c", 3, 1)
    assert after(act("activate", "c"), act("delete", "c")).content.active == "b"
    got = after(*[act("delete", p) for p in "abc"])
    assert [p.id for p in got.content.pages] == ["c"] and got.revision == 3


def test_reorder_takes_the_place_before_the_move():
    order = lambda *a: [p.id for p in after(act("reorder", *a)).content.pages]
    assert order("a", "c") == list("bca") and order("c", "a") == list("cab") and order("a", "a") == order("z", "a") == list("abc")


def test_history_keeps_twenty_snapshots():
    got = after(*[act("rotate", "a", delta=90)] * 25)
    assert (len(got.undo), got.revision, got.content.pages[0].rotation) == (20, 26, 90)
    got = after(*[act("rotate", "a", delta=90)] * 25, *["undo"] * 30)
    assert (len(got.undo), len(got.redo), got.revision, got.content.pages[0].rotation) == (0, 20, 46, 90 * 5 % 360)
    assert after(act("rotate", "a", delta=90), "undo", act("rotate", "b", delta=90)).redo == ()


def test_edits_replace_those_that_they_cover():
    edit = lambda *lines: act("edit", "a", line_ids=list(lines), value="".join(lines))
    lines = lambda *log: [held for held, _ in after(*log).content.pages[0].edits]
    assert lines(edit("1"), edit("2"), edit("3"), edit("2", "1")) == [("2", "1"), ("3",)]
    assert lines(edit("1", "2"), edit("2", "3")) == [("1", "2")] and lines(edit("1", "1")) == lines(edit()) == lines(edit("")) == []
    assert after(edit("1"), edit("1")).revision == 2
    assert lines(edit("1", "2"), edit("3"), act("remove", "a", line_ids=["2"])) == [("3",)]
    assert after(act("add", target="d"), act("edit", "d", line_ids=["1"], value="x")).revision == 2  # a blank page


def region(reviewed=True, roles="tl", selected=("m0",), lines=None):
    mappings = [{"id": f"m{i}", "role": {"t": "title", "l": "locked"}[r], "page_id": "a", "source_page": 0, "line_ids": (lines or [["1"], ["2"]])[i], "text": ""} for i, r in enumerate(roles)]
    return {"type": "region", "region": {"reviewed": reviewed, "mappings": mappings, "selected": list(selected)}}


def test_reviewed_regions_guard_fields():
    field = lambda m="m0", lines=("1",), page="a", **more: act("field", page, mapping_id=m, line_ids=list(lines), value="v", **more)
    got = after(region(), field())
    assert got.content.region.reviewed and got.content.region.mappings[0].text == "v" and (got.revision, len(got.undo)) == (2, 1)
    assert after(region(), field(revision=1)).revision == 2
    refused = [field("m1", ("2",)), field(lines=("1", "2")), field("m9"), field(page="b"), field(revision=7)]
    assert all(after(region(), a).revision == 1 for a in refused) and after(region(False), field()).revision == 1 and after(field()).revision == 1
    assert after(region(lines=[["1", "2"], ["2"]]), field(lines=("1", "2"))).revision == 1  # a locked one shares a line
    assert after(region(), region(roles="tt")).content.region.mappings[1].role == "locked"  # no change of mappings while reviewed
    assert after(region(), region(False), region(roles="tt")).content.region.mappings[1].role == "title"


def test_edits_and_undo_end_a_review():
    for log in ([act("rotate", "a", delta=90)], [act("add", target="n")]):
        got = after(region(), *log)
        assert (got.content.region.reviewed, got.content.region.selected) == (False, ())
    got = after(act("rotate", "a", delta=90), region(), act("field", "a", mapping_id="m0", line_ids=["1"], value="v"), "undo")
    assert not got.content.region.reviewed and got.content.region.mappings[0].text == "" and got.revision == 4
    assert after(region(), act("delete", "a")).content.region == replay.Region(False, (), ())


def test_loads_raise_the_revision_and_nothing_counts_before():
    assert replay.Document().content is None and after(act("rotate", "a", delta=90), load=act("rename", value="x")).revision == 0
    got = after(act("rotate", "a", delta=90), {**LOAD, "type": "restore", "revision": 40}, {**LOAD, "value": "m"})
    assert (got.revision, got.name, got.undo) == (42, "m", ())


# --- a second statement of the rules: nested lists, copied whole at every action ---


def second_replay(log):
    state = None
    for a in log:
        get, kind = a.get, a["type"]
        if kind in {"load", "restore"}:
            old = state["rev"] if state else 0
            pages = [dict(id=p["id"], blank=p.get("kind") == "blank", src=p.get("source_page"), orig=p.get("original", True), rot=p.get("rotation", 0), edits=[]) for p in get("pages") or []]
            state = {"rev": max(old, get("revision") or 0 if kind == "restore" else 0) + 1, "name": get("value") or "", "past": [], "future": [], "now": {"pages": pages, "on": pages[0]["id"] if pages else None, "reg": copy.deepcopy(get("region"))}}
        if state is None or kind in {"load", "restore"}:
            continue
        if kind == "rename":
            state["name"] = get("value") or ""
            continue
        now = copy.deepcopy(state["now"])
        ids = [p["id"] for p in now["pages"]]
        page = now["pages"][ids.index(get("page_id"))] if get("page_id") in ids else None
        reg = now["reg"]
        if kind == "activate":
            if page and now["on"] != page["id"]:
                now["on"] = page["id"]
                state.update(now=now, rev=state["rev"] + 1)
            continue
        if kind == "region":
            new = get("region")
            if not (reg and reg["reviewed"] and new["reviewed"] and reg["mappings"] != new["mappings"]):
                state["now"]["reg"] = copy.deepcopy(new)
            continue
        if kind in {"undo", "redo"}:
            a_, b_ = ("past", "future") if kind == "undo" else ("future", "past")
            if state[a_]:
                state[b_] = (state[b_] + [state["now"]])[-20:]
                state["now"] = copy.deepcopy(state[a_].pop())
                if state["now"]["reg"] and state["now"]["reg"]["reviewed"]:
                    state["now"]["reg"].update(reviewed=False, selected=[])
                state["rev"] += 1
            continue

        def write(lines):
            clash = not lines or "" in lines or len(lines) != len(set(lines)) or page["blank"]
            touched = [e for e in page["edits"] if set(e[0]) & set(lines)]
            if clash or any(set(e[0]) - set(lines) for e in touched):
                return False
            new = [list(lines), get("value") or ""]
            if touched:
                page["edits"][page["edits"].index(touched[0])] = new
                page["edits"] = [e for e in page["edits"] if e is new or not any(e is t for t in touched)]
            else:
                page["edits"].append(new)
            return True

        lines = get("line_ids") or []
        if kind == "rotate" and page and get("delta") is not None and get("delta") % 90 == 0:
            page["rot"] = (page["rot"] + int(get("delta"))) % 360
        elif kind == "add" and get("target_id") not in [*ids, None]:
            now["pages"].append(dict(id=get("target_id"), blank=True, src=None, orig=False, rot=0, edits=[]))
            now["on"] = get("target_id")
        elif kind == "duplicate" and page and get("target_id") not in [*ids, None]:
            now["pages"].insert(ids.index(page["id"]) + 1, {**copy.deepcopy(page), "id": get("target_id"), "orig": page["orig"] and page["blank"]})
            now["on"] = get("target_id")
        elif kind == "delete" and page and len(ids) > 1:
            at = ids.index(page["id"])
            del now["pages"][at]
            if now["on"] == page["id"]:
                now["on"] = now["pages"][at if at < len(now["pages"]) else -1]["id"]
            if reg:
                reg["mappings"] = [m for m in reg["mappings"] if m["page_id"] != page["id"]]
                reg["selected"] = [s for s in reg["selected"] if s in [m["id"] for m in reg["mappings"]]]
        elif kind == "reorder" and page and get("target_id") in ids:
            to = ids.index(get("target_id"))
            now["pages"].remove(page)
            now["pages"].insert(to, page)
        elif kind == "edit" and page:
            write(lines)
        elif kind == "remove" and page:
            page["edits"] = [e for e in page["edits"] if not set(lines) & set(e[0])]
        elif kind == "field" and page and reg and reg["reviewed"] and get("revision") in (None, state["rev"]):
            for m in [m for m in reg["mappings"] if m["id"] == get("mapping_id")][:1]:
                locked = {x for o in reg["mappings"] if o["role"] == "locked" and o["page_id"] == page["id"] for x in o["line_ids"]}
                if m["role"] != "locked" and m["page_id"] == page["id"] and m.get("source_page") == page["src"] and m["line_ids"] == lines and not locked & set(lines):
                    was = copy.deepcopy(page["edits"])
                    if write(lines) and page["edits"] != was:
                        m["text"] = get("value") or ""
        if now == state["now"]:
            continue
        state.update(past=(state["past"] + [state["now"]])[-20:], future=[], now=now, rev=state["rev"] + 1)
        if kind != "field" and reg and reg["reviewed"]:
            reg.update(reviewed=False, selected=[])
    if state is None:
        return None
    now, reg = state["now"], state["now"]["reg"] or {"mappings": [], "selected": [], "reviewed": False}
    return {
        "name": state["name"], "revision": state["rev"], "active": now["on"], "n_pages": len(now["pages"]), "pages": ",".join(p["id"] + f":{p['rot']}" + "*" * (not p["orig"]) for p in now["pages"]), "selected": ",".join(reg["selected"]), "reviewed": reg["reviewed"],
        "edits": ";".join(p["id"] + "=" + "|".join("+".join(lines) + ":" + text for lines, text in p["edits"]) for p in now["pages"] if p["edits"]), "mappings": ";".join(m["id"] + "@" + m["page_id"] + "!" * (m["role"] == "locked") + "=" + m["text"] for m in reg["mappings"]), "n_undo": len(state["past"]), "n_redo": len(state["future"]),
    }


def logs_of(actions):
    logs = {}
    for r in replay.as_json(actions).orderBy("doc", "seq", "action").collect():
        logs.setdefault(r.doc, []).append(json.loads(r.action))
    return logs


@pytest.fixture(scope="module")
def log(spark, sf):
    return R.full_actions(spark, sf).persist()


@pytest.fixture(scope="module")
def states(log):
    return {r.doc: {k: v for k, v in r.asDict().items() if k != "doc"} for r in replay.replay_actions(log).collect()}


def test_replay_equals_the_second_one(log, states):
    logs = logs_of(log)
    assert set(states) == set(logs) and len(logs) > 10
    for doc, actions in logs.items():
        assert states[doc] == second_replay(actions), doc
    assert any(s["edits"] for s in states.values()) and any(s["reviewed"] for s in states.values()) and any("n" in s["pages"] for s in states.values())


def test_random_logs_replay_alike():
    rng = random.Random(11)
    seen = {"reviewed": 0, "text": 0, "edits": 0, "redo": 0, "copies": 0}
    pages = [{"id": f"p{i}", "kind": "blank" if i == 2 else "pdf", "source_page": i, "original": True, "rotation": 0} for i in range(3)]
    kinds = ("rotate", "add", "duplicate", "delete", "reorder", "activate", "undo", "redo", "edit", "edit", "remove", "region", "region", "field", "field", "field", "rename")
    for _ in range(500):
        actions = [{"type": "load", "pages": pages[: rng.randint(1, 3)]}]
        for _ in range(rng.randint(1, 120)):
            kind = rng.choice(kinds) if rng.random() < 0.99 else rng.choice(["load", "restore"])
            a = {"type": kind, "page_id": rng.choice(["p0", "p0", "p1", "p2", "n1", "x"]), "target_id": rng.choice(["p0", "p1", "n1", "n2", "n3"]), "delta": rng.choice([90, 180, 360, 45, -90]), "line_ids": rng.choice([["1"], ["1"], ["2"], ["1", "2"], [], ["3", "3"]]), "value": rng.choice("abc"), "mapping_id": rng.choice(["m0", "m1"]), "pages": pages}
            if rng.random() < 0.1 and kind in ("restore", "field"):
                a["revision"] = rng.randint(0, 30)
            if kind == "region":
                mappings = [{"id": "m0", "role": "title", "page_id": "p0", "source_page": 0, "line_ids": ["1"], "text": ""}, {"id": "m1", "role": rng.choice(["locked", "date"]), "page_id": "p1", "source_page": rng.choice([0, 1]), "line_ids": rng.choice([["1", "2"], ["1"]]), "text": ""}]
                a["region"] = {"reviewed": rng.random() < 0.7, "mappings": mappings[: rng.randint(1, 2)], "selected": ["m0"]}
            actions.append(a)
        document = replay.Document()
        for a in actions:
            document.apply(a)
        want = second_replay(actions)
        assert document.row() == want, actions
        assert replay.Document.load(document.dump()) == document
        seen["reviewed"] += want["reviewed"]
        seen["text"] += "=" in want["mappings"] and any(m[-1] in "abc" for m in want["mappings"].split(";"))
        seen["edits"] += bool(want["edits"])
        seen["redo"] += want["n_redo"] > 0
        seen["copies"] += "*" in want["pages"]
    assert all(v > 5 for v in seen.values()), seen


def test_stream_gives_the_rows_of_the_batch(spark, log, states, tmp_path):
    parts = log.withColumn("slice", F.expr("seq div 20"))
    for k in sorted(r.slice for r in parts.select("slice").distinct().collect()):
        parts.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.replay_actions(source).writeStream.format("memory").queryName("replayed").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {}
    for r in spark.table("replayed").collect():
        row = r.asDict()
        assert row.pop("n_late") == 0
        doc = row.pop("doc")
        got[doc] = max(got.get(doc, row), row, key=lambda x: x["revision"])
    final = {d: s for d, s in got.items() if s["revision"] == states[d]["revision"]}
    assert set(got) == set(states) and len(query.recentProgress) > 2
    assert {d: final[d]["pages"] for d in states} == {d: s["pages"] for d, s in states.items()}


def test_late_actions_are_counted(spark, tmp_path):
    schema = "doc string, seq long, type string, page_id string, delta double, value string, pages array<struct<id:string>>"
    slices = [[("d", 1, "load", None, None, "n", [("a",)]), ("d", 5, "rotate", "a", 90.0, None, None)], [("d", 3, "rotate", "a", 90.0, None, None), ("d", 6, "rotate", "a", 180.0, None, None)]]
    for k, rows in enumerate(slices):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.replay_actions(source).writeStream.format("memory").queryName("late").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.pages, r.n_late, r.revision) for r in spark.table("late").collect()) == [("a:270", 1, 3), ("a:90", 0, 2)]


def test_edges_of_logs(spark):
    schema = "doc string, seq long, type string, page_id string"
    assert replay.replay_actions(spark.createDataFrame([], schema)).collect() == []
    rows = [("d", 1, "rotate", "a"), ("d", 1, "rotate", "a"), (None, 1, "add", None), ("e", None, "nothing", None), ("e", 2, "load", None), ("e", 3, "undo", None), ("e", 4, "activate", "x")]
    got = {r.doc: r for r in replay.replay_actions(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"d", "e"} and got["d"].revision == 0 and (got["e"].revision, got["e"].n_pages, got["e"].active) == (1, 0, None)

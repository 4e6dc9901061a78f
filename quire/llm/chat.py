"""Chat formatting: records of any known layout become canonical turns, turns become training text with a loss mask.

The nested field paths of a record's payload are hashed; the hash selects a declarative mapping, a Layout, that says
where turns, roles and texts are. All of it is built-in functions: no Python runs on the executors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are.

    A record has the layout if the paths that any layout knows of are, in the record, all of `paths` and any of
    `optional`; other fields of a record do not count. Turns are the elements of the list `each`, or the record
    itself if that is None and `role` is set, or the `fixed` ones: (role, paths of its text), the texts joined by an
    empty line. `role` and `text` are read in an element; `part` is the text inside each element of a list of parts
    at `text`. `order` is a number that sorts turns of several records. `roles` maps names of roles, others stay.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str | None = None
    role: str | None = None
    text: str | None = None
    part: str | None = None
    order: str | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


NAMES = (("human", "user"), ("gpt", "assistant"), ("chatgpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("rows", ("$.role", "$.text"), ("$.turn",), role="$.role", text="$.text", order="$.turn"),
    Layout("messages", ("$.messages", "$.messages[].content", "$.messages[].role"), ("$.prompt",), "$.messages", "$.role", "$.content"),
    Layout("message parts", ("$.messages", "$.messages[].content", "$.messages[].content[].text", "$.messages[].role"), (), "$.messages", "$.role", "$.content", "$.text"),
    Layout("conversations", ("$.conversations", "$.conversations[].from", "$.conversations[].value"), (), "$.conversations", "$.from", "$.value", roles=NAMES),
    Layout("prompt, completion", ("$.prompt", "$.completion"), ("$.system",), fixed=(("system", ("$.system",)), ("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Layout("prompt, response", ("$.prompt", "$.response"), ("$.system",), fixed=(("system", ("$.system",)), ("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Layout("prompt, chosen", ("$.prompt", "$.chosen"), ("$.system", "$.rejected"), fixed=(("system", ("$.system",)), ("user", ("$.prompt",)), ("assistant", ("$.chosen",)))),
    Layout("instruction", ("$.instruction", "$.output"), ("$.input", "$.system"), fixed=(("system", ("$.system",)), ("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("question", ("$.question", "$.answer"), ("$.context",), fixed=(("user", ("$.context", "$.question")), ("assistant", ("$.answer",)))),
)

#: The marks of the template. No text holds any of them once it is escaped.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What may begin a control string, and what then makes it one: `<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`, `<<SYS>>`, `<</SYS>>`.
OPENS, CONTROLS = r"([<\[])", r"(\||/?s>|/?INST\]|/?SYS>>)"


def field_paths(payload: Column) -> Column:
    """The nested field paths of a variant, as in `$.messages[].role`; null for null.

    Spark says the schema of a variant as text; one fold over its names and brackets keeps the path of the open
    fields. Names that are not plain stay in backticks.
    """
    tokens = F.regexp_extract_all(F.schema_of_variant(payload), F.lit(r"(`(?:[^`]|``)*`: |[^<>,:`() ]+: |[^<>,:`() ]+|[<>])"), 1)
    none = F.array().cast("array<string>")

    def step(state: Column, token: Column) -> Column:
        field = F.concat(F.element_at(state["open"], -1), F.lit("."), F.regexp_replace(token, ": $", ""))
        shut = F.slice(state["open"], F.lit(1), F.greatest(F.size(state["open"]) - 1, F.lit(0)))
        named = token.endswith(": ")
        return F.struct(
            F.when(token == "<", F.concat(state["open"], F.array(state["at"]))).when(token == ">", shut).otherwise(state["open"]).alias("open"),
            F.when(named, field).when(token == "ARRAY", F.concat(state["at"], F.lit("[]"))).otherwise(state["at"]).alias("at"),
            F.when(named, F.concat(state["paths"], F.array(field))).otherwise(state["paths"]).alias("paths"),
        )

    return F.aggregate(tokens, F.struct(none.alias("open"), F.lit("$").alias("at"), none.alias("paths")), step, lambda s: F.array_distinct(s["paths"]))


def _hash(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprint(payload: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """SHA-256 of the record's field paths that some layout knows of, sorted, a line each."""
    known = sorted({p for x in layouts for p in (*x.paths, *x.optional)})
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(field_paths(payload), F.array(*map(F.lit, known)))), "\n"), 256)


def fingerprints(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, str]:
    """Each fingerprint with the name of its layout; a layout has one for each choice of its optional paths."""
    found: dict[str, str] = {}
    for x in layouts:
        for n in range(len(x.optional) + 1):
            for some in combinations(x.optional, n):
                if found.setdefault(_hash({*x.paths, *some}), x.name) != x.name:
                    raise ValueError(f"{x.name} and {found[_hash({*x.paths, *some})]} have the same paths")
    return found


def _turns(v: Column, x: Layout) -> Column:
    """array<struct<role, text>> of a payload with layout x."""
    read = lambda e, path: F.try_variant_get(e, path, "string")
    names = dict(x.roles)
    role = lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(y) for pair in names.items() for y in pair]), r), r) if names else r

    def turn(e: Column) -> Column:
        text = read(e, x.text)
        if x.part:
            text = F.array_join(F.transform(F.try_variant_get(e, x.text, "array<variant>"), lambda p: read(p, x.part)), "")
        return F.struct(F.coalesce(role(read(e, x.role)), F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if x.fixed:
        fixed = []
        for name, paths in x.fixed:
            texts = F.filter(F.array(*[read(v, p) for p in paths]), lambda t: t.isNotNull() & (t != ""))
            made = F.struct(F.lit(name).alias("role"), F.array_join(texts, "\n\n").alias("text"))
            fixed.append(F.when(F.size(texts) > 0, made) if all(p in x.optional for p in paths) else made)
        return F.filter(F.array(*fixed), lambda t: t.isNotNull())
    if x.each:
        return F.transform(F.try_variant_get(v, x.each, "array<variant>"), turn)
    return F.array(turn(v))


def classify_records(records: DataFrame, id_col: str = "conv_id", payload_col: str = "payload", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, payload, fingerprint, layout) for each record; the layout is null where no mapping has the fingerprint.

    The payload is a variant. A null payload has neither. A layout name for each fingerprint is a literal of the plan,
    as large as the layouts.
    """
    rows = records.select(F.col(id_col).alias("id"), F.col(payload_col).alias("payload"))
    rows = rows.withColumn("fingerprint", F.when(F.col("payload").isNotNull(), fingerprint(F.col("payload"), layouts)))
    names = F.create_map(*[F.lit(y) for pair in fingerprints(layouts).items() for y in pair])
    return rows.withColumn("layout", F.element_at(names, F.col("fingerprint")))


def canonical_turns(records: DataFrame, id_col: str = "conv_id", payload_col: str = "payload", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, turn, pos, role, text): the turns of records with a known layout, in the order `turn`, `pos`.

    `turn` is the layout's order (null where it has none), `pos` the place within a record. Null roles and texts
    become empty; what is no string, as a nested list, becomes its JSON text. Records without a layout and lists
    without elements give no turns; classify_records shows which. Several records of one id join into one conversation.
    """
    rows = classify_records(records, id_col, payload_col, layouts)
    turns, order = F.lit(None), F.lit(None).cast("bigint")
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, _turns(F.col("payload"), x)).otherwise(turns)
        if x.order:
            order = F.when(F.col("layout") == x.name, F.try_variant_get("payload", x.order, "bigint")).otherwise(order)
    return rows.select("id", order.alias("turn"), F.posexplode(turns).alias("pos", "t")).select("id", "turn", "pos", "t.role", "t.text")


def escaped(text: Column) -> Column:
    """The text with one more backslash inside everything that is a control string but for backslashes."""
    return F.regexp_replace(text, OPENS + r"(\\*)" + CONTROLS, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    """The inverse of escaped: one backslash less where at least one stands inside a control string."""
    return F.regexp_replace(text, OPENS + r"\\(\\*)" + CONTROLS, "$1$2$3")


def format_conversations(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id, formatted, loss_starts, loss_lengths) for each conversation of canonical turns.

    Each turn is TURN role TEXT text END, role and text escaped. Turns are sorted by turn (nulls first), pos, role and
    text, so ties and repeated rows are in a fixed order and all stay. The loss mask has a span for each turn, in code
    points of the formatted text: that of its text if its role is in `learn`, else one of length zero. Offsets come
    from one ordered pass, which spills; the conversation itself is one row, as a training text is, so it must fit one
    string (2 GB). A null id is a conversation like others; no turns, no rows.
    """
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(TURN), role, F.lit(TEXT))
    rows = turns.select("id", "turn", "pos", "role", "text", F.concat(head, text, F.lit(END)).alias("piece"), F.length(head).alias("lead"), F.coalesce(F.col("role").isin(*learn), F.lit(False)).alias("learned"))
    order = Window.partitionBy("id").orderBy("turn", "pos", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("stop", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.length("piece").cast("bigint")
    start = F.col("stop") - size + F.col("lead")
    length = F.when(F.col("learned"), size - F.col("lead") - len(END)).otherwise(0)
    parts = F.array_sort(F.collect_list(F.struct("n", "piece", start.alias("start"), length.alias("length"))))
    return rows.groupBy("id").agg(parts.alias("p")).select("id", F.array_join("p.piece", "").alias("formatted"), F.col("p.start").alias("loss_starts"), F.col("p.length").alias("loss_lengths"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(id, chars, n, role, text, loss_text) for each turn, from the formatted text and the loss mask alone.

    chars is the length of the whole formatted text. loss_text is what the mask covers, unescaped, null where it covers nothing. Pieces are cut at END and their
    offsets summed again, so each span is looked up in its own piece and the work follows the length of the text.
    """
    mark = lambda *names: "|".join(n.replace("|", r"\|") for n in names)
    pieces = F.split("formatted", mark(END))
    rows = formatted.select("id", F.length("formatted").cast("bigint").alias("chars"), "loss_starts", "loss_lengths", F.posexplode(F.slice(pieces, F.lit(1), F.size(pieces) - 1)).alias("n", "piece"))
    rows = rows.select("id", "chars", "n", "piece", F.get("loss_starts", "n").alias("start"), F.get("loss_lengths", "n").alias("size"))
    order = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("offset", F.sum(F.length("piece") + len(END)).over(order) - F.length("piece") - len(END))
    cut = F.split("piece", mark(TURN, TEXT))
    covered = F.substring("piece", (F.col("start") - F.col("offset") + 1).cast("int"), F.col("size").cast("int"))
    return rows.select("id", "chars", "n", unescaped(F.get(cut, 1)).alias("role"), unescaped(F.get(cut, 2)).alias("text"), F.when(F.col("size") > 0, unescaped(covered)).alias("loss_text"))


def conversation_digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted conversations, read back."""
    parts = F.array_sort(F.collect_list(F.struct("n", "role", "text", "loss_text")))
    turns = read_back(formatted).groupBy("id").agg(parts.alias("t"), F.max("chars").alias("chars"))
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("t", lambda t: F.coalesce(t["loss_text"], F.lit(""))), "")
    count = lambda c: c.cast("bigint")
    return turns.select(
        F.col("id").alias(id_col), count(F.size("t")).alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), count(F.length(learned)).alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars")
    )

"""Small authored cases and invariants for operators, beside the comparison with SQL."""

import hashlib
import math
import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from quire import relations as R
from quire.functions.scratch import Scratch
from quire.operators import edits, fonts, geometry, intake, records, regions, spans, trees
from quire.sources.tables import export_backup_json


def test_entry_imports_and_registers(spark, sf):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_boundary_takes_the_right_run_and_the_end_the_last(spark):
    runs = spark.createDataFrame([(1, 0, 0, 0, 3, "abc", True), (1, 0, 1, 3, 6, "def", False)], "doc_id long, line_no long, run_no long, begin long, stop long, text string, bold boolean")
    at = spark.createDataFrame([(1, 0, x) for x in (0, 2, 3, 6, 99)], "doc_id long, line_no long, offset long")
    got = {r.offset: r.bold for r in spans.style_at(at, runs).collect()}
    assert got == {0: True, 2: True, 3: False, 6: False, 99: False}


def test_splice_keeps_text_and_style(spark):
    runs = spark.createDataFrame([(1, 0, 0, 0, 3, "abc", True), (1, 0, 1, 3, 6, "def", False)], "doc_id long, line_no long, run_no long, begin long, stop long, text string, bold boolean")
    edit = spark.createDataFrame([(1, 0, 2, 4, "XY")], "doc_id long, line_no long, cut_begin long, cut_stop long, inserted string")
    got = [(r.begin, r.stop, r.text, r.bold) for r in spans.splice_spans(edit, runs).orderBy("begin").collect()]
    assert got == [(0, 4, "abXY", True), (4, 6, "ef", False)]


def test_graphemes_snap_to_whole_characters(spark):
    text = "aé👨‍👩‍👧b"
    texts = spark.createDataFrame([(1, 0, text)], "doc_id long, line_no long, text string")
    cuts = spark.createDataFrame([(1, 0, 2, 5)], "doc_id long, line_no long, cut_begin long, cut_stop long")
    got = spans.snap_spans(cuts, texts).first()
    assert (got.begin, got.stop) == (1, len(text) - 1)


def test_normalisation_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\rc\td é"), (2, "plain"), (3, None)], "doc_id long, text string")
    once = spans.normalize_corpus(docs)
    got = {r.doc_id: (r.text, r.changed) for r in once.collect()}
    assert got == {1: ("a\nb\nc    d é", True), 2: ("plain", False), 3: (None, False)}
    assert not spans.normalize_corpus(once.drop("changed")).where("changed").count()


def delta(spark, old, new, begin, stop, kind="insertText"):
    schema = "k long, t long, text string, sel_begin long, sel_stop long, input_type string"
    v = spark.createDataFrame([(1, 1, old, 0, 0, ""), (1, 2, new, begin, stop, kind)], schema)
    r = spans.edit_delta(v, "k", "t").first()
    return r.begin, r.removed, r.inserted


def test_edit_delta(spark):
    assert delta(spark, "hello world", "hello brave world", 6, 6) == (6, "", "brave ")
    assert delta(spark, "aaa", "aa", 2, 2, "deleteContentBackward") == (1, "a", "")  # not the last or first a
    assert delta(spark, "aaa", "aa", 1, 1, "deleteContentForward") == (1, "a", "")
    assert delta(spark, "abc", "aXc", 1, 2) == (1, "b", "X")
    assert delta(spark, "teh cat", "the cat", 3, 3) == (1, "eh", "he")  # a correction reaches beyond the selection
    assert delta(spark, "aa", "aaa", 1, 1) == (1, "", "a")
    assert delta(spark, "x👨‍👩‍👧y", "xy", 6, 6, "deleteContentBackward") == (1, "👨‍👩‍👧", "")


def test_edit_delta_rebuilds_every_version(spark, sf):
    from quire.plans import all_queries

    rows = R.versions(spark, sf).collect()
    text, order = {(r.conv_id, r.turn): r.text for r in rows}, {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        order.setdefault(r.conv_id, []).append(r.turn)
    for r in all_queries()["w11_edit_delta"](spark, sf).collect():
        turns = order[r.conv_id]
        old = text[(r.conv_id, turns[turns.index(r.turn) - 1])]
        assert old[: r.begin] + r.inserted + old[r.begin + len(r.removed) :] == text[(r.conv_id, r.turn)]


def test_rows_are_anchored_at_their_first_item(spark):
    items = spark.createDataFrame([(1, 0, n, 10.0 + 0.3 * n, 0.0) for n in range(4)], "doc_id long, page_no long, line_no long, v double, u double")
    got = {r.line_no: r.row_no for r in geometry.row_bands(items).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}  # a chain of steps of 0.3 does not drift


def test_edges_are_strict_for_overlap_and_closed_for_selection(spark):
    schema = "doc_id long, page_no long, n long, x0 double, y0 double, x1 double, y1 double"
    a, b = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 128.0, 10.0)], schema), spark.createDataFrame([(1, 0, 2, 128.0, 0.0, 200.0, 10.0)], schema)
    assert geometry.box_join(a, b, geometry.overlaps).count() == 0
    assert geometry.box_join(a, b, geometry.touches).count() == 1


def test_random_boxes_match_brute_force(spark):
    rng = random.Random(5)
    boxes = [(1, rng.randint(0, 2), n, x, y, x + rng.uniform(0, 400), y + rng.uniform(0, 300)) for n in range(120) for x, y in [(rng.uniform(-200, 500), rng.uniform(-200, 500))]]
    df = spark.createDataFrame(boxes, "doc_id long, page_no long, n long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.a_n, r.b_n) for r in geometry.box_join(df, df, geometry.overlaps).collect())
    want = sorted((a[2], b[2]) for a in boxes for b in boxes if a[1] == b[1] and a[3] < b[5] and a[5] > b[3] and a[4] < b[6] and a[6] > b[4])
    assert got == want


def test_boxes_far_beyond_their_page_make_no_tiles(spark):
    rng = random.Random(9)
    side = lambda: rng.choice([5.0, 60.0, 300.0, 1e6, 1e12])
    boxes = [(1, 0, n, x, y, x + side(), y + side()) for n in range(150) for x, y in [(rng.uniform(-1e4, 1e4), rng.uniform(-1e4, 1e4))]]
    df = spark.createDataFrame(boxes, "doc_id long, page_no long, n long, x0 double, y0 double, x1 double, y1 double")
    for size in (128.0, 64.0):
        assert geometry._tiled(df, size, "a_").count() <= (geometry.TILES + 1) * len(boxes)
    got = sorted((r.a_n, r.b_n) for r in geometry.box_join(df, df, geometry.overlaps).collect())
    assert got == sorted((a[2], b[2]) for a in boxes for b in boxes if a[3] < b[5] and a[5] > b[3] and a[4] < b[6] and a[6] > b[4]) and len(got) > 1000


def test_baselines_by_direction_offset_and_glyph(spark):
    schema = "doc_id long, page_no long, line_id long, x double, y double, dx double, dy double"
    c, s = math.cos(0.3), math.sin(0.3)
    lines = spark.createDataFrame([(1, 0, 1, 10.0, 10.0, c, s)], schema)
    glyphs = spark.createDataFrame([(1, 0, 1, 10 + k * c, 10 + k * s) for k in (0, 5, 9)], "doc_id long, page_no long, line_id long, x double, y double")
    at = lambda k, off=0.0: (10 + k * c - off * s, 10 + k * s + off * c)
    turned = lambda a: (math.cos(0.3 + a), math.sin(0.3 + a))
    others = [(*at(5), c, s), (*at(9, 0.015), *turned(0.0008)), (*at(9), *turned(0.002)), (*at(5, 0.03), c, s), (*at(7), c, s), (*at(5), -c, -s)]
    other = spark.createDataFrame([(1, 0, n, *o) for n, o in enumerate(others)] + [(1, 1, 9, *at(5), c, s)], schema)
    assert {(r.a, r.b) for r in geometry.same_baseline(lines, glyphs, other, geometry.PAGE).collect()} == {(1, 0), (1, 1)}


def test_rules_between_rows_and_items(spark):
    items = [(0, 0, 0, 0.0, 0.0, 40.0, 10.0), (0, 0, 1, 60.0, 2.0, 90.0, 11.0), (0, 1, 2, 5.0, 20.0, 80.0, 30.0)]
    rulings = [(95.0, 15.0, -1.0, 15.0), (0.0, 15.0, 80.0, 15.0), (-1.0, 11.005, 95.0, 11.005), (50.0, 12.0, 50.0, -1.0), (50.0, 3.0, 50.0, 12.0), (40.005, -1.0, 40.005, 12.0), (55.0, -5.0, 55.004, 40.0)]
    df = spark.createDataFrame([(1, *i) for i in items], "doc_id long, page_no long, row_no long, item_no long, x0 double, y0 double, x1 double, y1 double")
    rules = spark.createDataFrame([(1, 0, *r) for r in rulings], "doc_id long, page_no long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.row_no, r.item_no, r.place) for r in geometry.ruling_crossings(df, rules).collect()}
    assert got == {(1, None, 15.0), (0, 1, 50.0), (0, 1, 55.0)}


def test_aliases_of_dropped_names_go(spark):
    aliases = [("a", "b"), ("b", "gone"), ("c", "d"), ("d", "kept"), ("e", "nowhere"), ("f", "g"), ("g", "f"), ("h", "a")]
    targets = [("gone", "p1"), ("kept", "p2")]
    got = trees.kept_names(spark.createDataFrame([("p2",)], "page string"), spark.createDataFrame(aliases, "name string, to string"), spark.createDataFrame(targets, "name string, target string"))
    assert {r.name for r in got.collect()} == {"c", "d", "kept", "e", "f", "g"}


@pytest.mark.parametrize("name", ["j6_near_match", "j7_same_baseline", "j8_box_overlap", "j9_box_contains", "j10_select_by_rectangle", "j11_layout_collisions", "j20_ruling_crossings", "j21_intervening_lines"])
def test_spatial_plans_have_no_nested_loops(spark, sf, name):
    from quire.plans import all_queries

    plan = all_queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_upper_median(spark):
    rows = [(1, 0, n, n, v, 0.0, 50.0, 12.0) for n, v in enumerate((0.0, 10.0, 24.0))]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, row_no long, line_no long, v double, u double, end_u double, size_pt double")
    assert geometry.leading_check(df).first().leading == 14.0


def test_protection_truth_table(spark):
    rows = [(1, 1, "writeProtection", None, None, None), (2, 1, "writeProtection", "recommended", "1", True), (3, 1, "writeProtection", "recommended", "1", True), (3, 1, "writeProtection", "hash", "x", False), (4, 1, "documentProtection", "enforcement", "off", False), (5, 1, "documentProtection", "enforcement", "1", False), (6, 1, "documentProtection", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, element_id long, element string, name string, value string, recommended boolean")
    assert {r.doc_id: r.protected for r in intake.protection_flags(df).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_a_refused_update_is_no_base_for_the_next(spark):
    fields = "id long, ord long, sequence long, revision long, modified boolean, format string, source_hash string, source_name string"
    store = spark.createDataFrame([(1, 5, 3, False, "docx", "h", "s")], "id long, sequence long, revision long, modified boolean, format string, source_hash string, source_name string")
    incoming = spark.createDataFrame([(1, 1, 9, 2, True, "docx", "h", "s"), (1, 2, 7, 4, True, "docx", "h", "s"), (1, 3, 8, 4, False, "docx", "h", "s")], fields)
    got = records.fold_upserts(store, incoming).first()
    assert (got.sequence, got.revision, got.modified, got.applied) == (7, 4, True, 1)


def test_long_groups_pass_in_batches(spark):
    """Groups longer than a batch, without one row that holds a group."""
    rng, fields = random.Random(6), "sequence long, revision long, modified boolean, format string, source_hash string, source_name string"
    stored = {i: (5, 3, False, "docx", None, "s") for i in (0, 1, None)}
    log = [(rng.choice([0, 0, 0, 1, 2, None]), n, rng.choice([n, n // 2, None]), rng.randint(0, 9), rng.random() < 0.9, "docx", rng.choice([None, None, "h"]), "s") for n in range(300)]
    want = {}
    for i in {None, 0, 1, 2}:
        rows = [r[2:] for r in log if r[0] == i]
        state, applied = (stored[i], 0) if i in stored else (rows.pop(0), 0)
        for r in rows:
            if r[3:] == state[3:] and None not in (r[0], state[0]) and r[0] > state[0] and r[1] >= state[1] and (r[2] or not state[2]):
                state, applied = r, applied + 1
        want[i] = (*state[:3], applied)
    files = [(f"s{n % 7 % 2}", f"p{n * 37 % 301:03}é", n, n % 5) for n in range(301)]
    listing = {s: "\n".join(["v1", *sorted(f"{p}|{z}|{m}" for k, p, z, m in files if k == s)]) for s in ("s0", "s1")}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        folded = records.fold_upserts(spark.createDataFrame([(i, *r) for i, r in stored.items()], f"id long, {fields}"), spark.createDataFrame(log, f"id long, ord long, {fields}"))
        stamps = intake.fingerprint_partitions(spark.createDataFrame(files, "source string, path string, size long, modified long"), "v1")
        assert {r.id: (r.sequence, r.revision, r.modified, r.applied) for r in folded.collect()} == want
        assert {r.source: r.fingerprint for r in stamps.collect()} == {s: hashlib.sha256(t.encode()).hexdigest() for s, t in listing.items()}
    finally:
        spark.conf.set(key, before)
    for df in (folded, stamps):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_every_record_goes_one_way(spark, sf):
    store = R.store(spark, sf)
    good, bad = records.quarantine_route(store, "b", F.current_timestamp())
    assert good.count() + bad.count() == store.count() and {r.batch_id for r in bad.collect()} == {"b"}


def test_backup_refuses_what_json_cannot_hold(spark):
    rows = spark.createDataFrame([(1, 1.5, b"ab", "t"), (2, None, None, "t")], "id long, zoom double, content binary, type string")
    assert [r.json for r in export_backup_json(rows).orderBy("id").collect()] == ['{"id":1,"zoom":1.5,"source":{"__blob__":true,"type":"t","base64":"YWI="}}', '{"id":2,"source":{"__blob__":true,"type":"t"}}']
    with pytest.raises(Exception, match="JSON cannot hold"):
        export_backup_json(rows.withColumn("zoom", F.expr("double('NaN')"))).collect()
    with pytest.raises(ValueError):
        export_backup_json(rows.withColumn("raw", F.col("content")))


def test_migration_leaves_rejected_drafts_as_they_came(spark):
    schema = "id long, version long, zoom double, images array<string>, signature_fields array<string>, text_boxes array<string>, shapes array<string>, highlight string, line_id string, line_ids array<string>"
    rows = [(1, 2, 1.0, [], None, None, None, None, "a", None), (2, 3, 1.0, ["x"], None, None, None, None, None, ["b"]), (3, 4, 0.0, [], None, None, None, None, None, ["c"]), (4, 5, 1.0, None, None, None, None, "h", None, ["d"]), (5, 1, 1.0, None, None, None, None, None, None, None)]
    got = {r.id: (r.version, r.line_ids, r.images, r.reason) for r in records.migrate_records(spark.createDataFrame(rows, schema), F.when(F.col("zoom") <= 0, "zoom")).collect()}
    assert got == {1: (5, ["a"], None, None), 2: (3, ["b"], ["x"], "obsolete"), 3: (4, ["c"], [], "zoom"), 4: (5, ["d"], None, None), 5: (1, None, None, "version")}


def test_cycles_end(spark):
    tree = spark.createDataFrame([("a", "b", None), ("b", "c", None), ("c", "a", "C"), ("d", "c", "D")], "node string, parent string, value string")
    assert {r.node: r.value for r in trees.inherit_attribute(tree).collect()} == {"a": "C", "b": "C", "c": "C", "d": "D"}


def test_a_chain_of_a_thousand_is_followed_to_its_root(spark):
    names = [f"n{i:04}" for i in range(1000)]
    tree = spark.createDataFrame([(n, p, None if p else "top", False) for n, p in zip(names, [None, *names])], "node string, parent string, value string, gone boolean")
    assert {r.node: r.value for r in trees.inherit_attribute(tree).collect()} == dict.fromkeys(names, "top")
    aliases = spark.createDataFrame(list(zip(names[1:], names)), "name string, to string")
    got = trees.resolve_aliases(aliases, spark.createDataFrame([(names[0], "page")], "name string, target string"))
    assert {(r.name, r.target, r.status) for r in got.collect()} == {(n, "page", "ok") for n in names[1:]}
    assert trees.prune_tree(tree).count() == 1000
    assert trees.prune_tree(tree.withColumn("gone", F.col("node") == names[0])).count() == 0
    assert trees.clone_subtree(tree, tree.where(F.col("node") == names[500]).select("node"), "c").count() == 1500
    refs = spark.createDataFrame([(1, None, names[999]), (2, None, "n9"), (3, "page", None)], "ref_id long, page string, name string")
    kept = trees.drop_dangling(refs, spark.createDataFrame([("page",)], "page string"), aliases, spark.createDataFrame([(names[0], "page")], "name string, target string"))
    assert {r.ref_id for r in kept.collect()} == {1, 3}


def test_random_trees_match_plain_walks(spark):
    rng = random.Random(4)
    parent = {f"n{i}": (f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else None) for i in range(120)}
    parent |= {"x0": "x1", "x1": "x2", "x2": "x0", "x3": "x1", "y0": "y0", "z": "gone from here"}
    value = {n: n.upper() if rng.random() < 0.2 and n[0] != "x" else None for n in parent}
    gone = {n: rng.random() < 0.1 for n in parent}
    tree = spark.createDataFrame([(n, p, value[n], gone[n]) for n, p in parent.items()], "node string, parent string, value string, gone boolean")

    def up(n):
        seen = []
        while n in parent and n not in seen:
            seen.append(n)
            n = parent[n]
        return seen

    assert {r.node: r.value for r in trees.inherit_attribute(tree).collect()} == {n: next((value[a] for a in up(n) if value[a]), None) for n in parent}
    inner = set(parent.values())
    leaves = {n for n in parent if n not in inner and not any(gone[a] for a in up(n))}
    assert {r.node for r in trees.prune_tree(tree).collect()} == {a for n in leaves for a in up(n)}
    edges = tree.where("parent is not null").select("node", "parent")
    bad = trees.tree_consistency(edges, tree.select("node", "parent"), edges.select("node", F.lit(1).alias("page")), spark.createDataFrame([(1,)], "page int"))
    assert {(r.node, r.violation) for r in bad.collect()} == {(n, "cycle") for n in ("x0", "x1", "x2", "y0")}


def test_ways_into_cycles_end_in_few_rounds(spark, tmp_path):
    """A cycle of three, one of its own, a way of sixty into the first and two thousand nodes under a root."""
    parent = {"c0": "c1", "c1": "c2", "c2": "c0", "own": "own", "w0": "c1"} | {f"w{i}": f"w{i - 1}" for i in range(1, 60)} | {f"n{i}": "root" for i in range(2000)}
    nodes = spark.createDataFrame([(n, p, None) for n, p in parent.items()], "node string, parent string, value string")
    scratch = Scratch(spark)
    scratch.base = str(tmp_path)
    rows = trees.climb(nodes, scratch).collect()
    assert len(rows) == len(parent) and {r.node for r in rows if r.up} == {n for n in parent if n[0] != "n"}
    assert {r.up for r in rows if r.up} == {"c0", "c1", "c2", "own"}
    assert len(list(tmp_path.iterdir())) <= 9  # log2 of the longest way, whatever the number of nodes


def test_aliases_are_not_sent_through_the_driver(spark):
    aliases = spark.createDataFrame([("a", "t"), ("b", "a")], "name string, to string")
    targets = spark.createDataFrame([("t", "page")], "name string, target string")
    kept = spark.createDataFrame([("page",)], "page string")
    for rows in (trees.resolve_aliases(aliases, targets), trees.kept_names(kept, aliases, targets)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert rows.count() and "strategy=broadcast" not in plan
    assert trees.resolve_aliases(aliases, targets)._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 0


@pytest.mark.parametrize("name", ["w12_space_inference", "a5_plain_text"])
def test_characters_and_words_of_a_line_are_not_shuffled(name, spark, sf):
    import __spark_entry__ as entry

    assert "Exchange" not in entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_bounds_of_characters_are_folded_before_they_are_dealt(spark, sf):
    import __spark_entry__ as entry

    plan = entry.queries()["a4_assemble_lines"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "collect_list" not in plan and "SortAggregate" not in plan and plan.count("Generate") == 3


def test_only_fonts_and_files_that_fit_meet(spark):
    """Two thousand of one name: pairs are not compared, and not dealt again to be made distinct."""
    declared = spark.range(2000).selectExpr("id as font_id", "'Serif' as name", "int(if(id % 2 = 0, 400, 700)) as weight", "false as italic")
    files = spark.range(2000).selectExpr("id as file_id", "'serif' as family", "'Serif Full' as full_name", "int(if(id = 7, 700, 900)) as weight", "false as italic")
    rows = fonts.match_font_file(declared.unionByName(declared), files)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Project") or plan.lstrip().startswith("Generate")
    assert sorted((r.font_id, r.file_id) for r in rows.collect()) == [(i, 7) for i in range(1, 2000, 2)]


def test_pairs_of_fonts_and_files_are_stored_in_a_small_part_of_their_size(spark, tmp_path):
    """Two million pairs of 128 names, 16 bytes each: a file keeps them in less than two."""
    declared = spark.range(16000).selectExpr("id * 7919 as font_id", "concat('Serif ', id % 128) as name", "int(null) as weight", "boolean(null) as italic")
    files = spark.range(16000).selectExpr("id * 104729 as file_id", "concat('serif-', id % 128) as family", "'Full' as full_name", "400 as weight", "false as italic")
    fonts.match_font_file(declared, files).write.parquet(f"{tmp_path}/pairs")
    rows = spark.read.parquet(f"{tmp_path}/pairs")
    assert rows.count() == rows.distinct().count() == 2_000_000 and rows.where("font_id div 7919 % 128 <> file_id div 104729 % 128").isEmpty()
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 4_000_000


def test_fonts_and_files_without_an_id_are_matched(spark):
    declared = spark.createDataFrame([(1, "Serif", None, None), (None, "Serif", None, None)], "font_id long, name string, weight int, italic boolean")
    files = spark.createDataFrame([(5, "Serif", "Full", 400, False), (None, "Serif", "Full", 400, False), (None, "Sans", "Serif", 700, True)], "file_id long, family string, full_name string, weight int, italic boolean")
    assert {tuple(r) for r in fonts.match_font_file(declared, files).collect()} == {(1, 5), (1, None), (None, 5), (None, None)}
    assert fonts.match_font_file(declared.where("false"), files).isEmpty() and fonts.match_font_file(declared, files.where("false")).isEmpty()


def test_references_are_not_dealt_by_a_few_names(spark, sf):
    import __spark_entry__ as entry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # below the size of the documents
    try:
        plan = entry.queries()["t7_replace_font_refs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_forks_have_the_same_ids_when_made_again(spark, sf):
    store = R.store(spark, sf)
    once, again = (records.fork_archive(store, "opened", F.lit(1).cast("bigint")).where("sequence = 0") for _ in range(2))
    assert {r.id for r in once.collect()} == {r.id for r in again.repartition(3).collect()}
    assert once.select("id").distinct().count() == store.count() and once.first().id.count("-") == 4


def test_a_text_of_empty_runs_keeps_one(spark):
    rows = [(1, 0, 0, 0, 0, "", True), (1, 0, 1, 0, 0, "", False), (2, 0, 0, 0, 0, "", True), (2, 0, 1, 0, 2, "ab", False)]
    runs = spark.createDataFrame(rows, "doc_id long, line_no long, run_no long, begin long, stop long, text string, bold boolean")
    got = lambda df: {(r.doc_id, r.text, r.bold) for r in df.collect()}
    assert got(spans.style_runs(runs)) == {(1, "", True), (2, "ab", False)}
    assert got(spans.style_runs(runs, fallback=F.lit(False))) == {(1, "", False), (2, "ab", False)}


def test_a_grapheme_keeps_the_style_of_its_first_character(spark):
    pieces = [("xe", True), ("\u0301\r", False), ("\n\tz", True), ("e", False), ("\u0301", True)]
    rows, at = [], 0
    for n, (text, bold) in enumerate(pieces):
        rows.append((1, 0, n, at, at + len(text), text, bold))
        at += len(text)
    runs = spark.createDataFrame(rows, "doc_id long, line_no long, run_no long, begin long, stop long, text string, bold boolean")
    got = [(r.begin, r.stop, r.text, r.bold) for r in spans.normalize_runs(runs).orderBy("begin").collect()]
    assert got == [(0, 2, "xé", True), (2, 3, "\n", False), (3, 8, "    z", True), (8, 9, "é", False)]


def test_runs_normalise_like_a_plain_fold(spark):
    """Edges move to the end of the grapheme that they cut, over as many runs as it takes."""
    rng = random.Random(8)
    letters = ["a", "b", "e", "\u0301", "\u0323", "\r", "\n", "\t", "\u200d", "\U0001f468", "\U0001f469", "\U0001f3fd", "\ufe0f", "\U0001f1e9", "\U0001f1ea", "\u1100", "\u1161", "\u11a8", "\uac00", "\u0915", "\u093f", "\u0600", "é", "中"]
    texts = {t: [("".join(rng.choices(letters, k=rng.choice([0, 1, 1, 2, 3]))), rng.random() < 0.5) for _ in range(rng.randint(1, 9))] for t in range(600)}
    rows = []
    for t, runs in texts.items():
        at = 0
        for n, (text, bold) in enumerate(runs):
            rows.append((t, 0, n, at, at + len(text), text, bold))
            at += len(text)
    runs = spark.createDataFrame(rows, "doc_id long, line_no long, run_no long, begin long, stop long, text string, bold boolean")
    got = {}
    for r in spans.normalize_runs(runs).orderBy("doc_id", "begin", "run_no").collect():
        got.setdefault(r.doc_id, []).append((r.begin, r.stop, r.text, r.bold))
    moved = 0
    for t, parts in texts.items():
        whole, styles = "".join(text for text, _ in parts), [bold for text, bold in parts for _ in text]
        pieces, at = [], 0
        for g in regex.findall(r"\X", whole):
            style, at = styles[at], at + len(g)
            moved += len(set(styles[at - len(g) : at])) > 1
            g = unicodedata.normalize("NFC", g.replace("\r\n", "\n").replace("\r", "\n").replace("\t", "    "))
            if pieces and pieces[-1][1] == style:
                pieces[-1][0] += g
            else:
                pieces.append([g, style])
        pieces = pieces or [["", parts[0][1]]]
        stops = [sum(len(p[0]) for p in pieces[: k + 1]) for k in range(len(pieces))]
        assert got[t] == [(stop - len(text), stop, text, style) for (text, style), stop in zip(pieces, stops)], parts
    assert moved > 100


def test_stable_letters_stay_in_nfc():
    pattern = regex.compile(regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: regex.escape(chr(int(m[1], 16))), spans.STABLE))
    stable = [c for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000 and pattern.match(c)]
    marks = ["\u0301", "\u0323", "\u3099", "\u1161", "\u11a8"]
    assert len(stable) > 30_000 and not any(pattern.match(m) for m in marks)
    assert all(unicodedata.normalize("NFC", c) == c for c in stable)
    text = "".join(stable)
    assert unicodedata.normalize("NFC", text) == text and unicodedata.normalize("NFC", text[::-1]) == text[::-1]


def test_rows_are_banded_like_a_plain_fold(spark):
    rng = random.Random(6)
    rows = [(d, 0, n, rng.choice([0.1, 0.2, 0.49, 0.5, 3.0]) * rng.randint(0, 30), rng.random()) for d in range(5) for n in range(80)]
    want = {}
    for d in range(5):
        row, anchor = -1, None
        for _, _, n, v, u in sorted((r for r in rows if r[0] == d), key=lambda r: (r[3], r[4], r[2])):
            if anchor is None or not v - anchor < 0.5:
                row, anchor = row + 1, v
            want[(d, n)] = row
    items = spark.createDataFrame(rows, "doc_id long, page_no long, line_no long, v double, u double")
    assert {(r.doc_id, r.line_no): r.row_no for r in geometry.row_bands(items).collect()} == want


def test_fonts_of_partial_pages_and_several_names(spark):
    rows = [(1, 1, "ABCDEF+A", True, "p", False, False, 400, None, None), (1, 2, "B", False, "q", False, False, None, "i", None), (1, 3, "C", True, "r", False, False, 700, None, None), (1, 3, "D", True, "r", False, False, 700, None, None), (1, 4, "E", True, "s", False, False, 400, None, None), (1, 5, "E", True, "s", False, False, None, None, None), (2, 6, "A", True, "p", False, False, 400, None, None), (3, 7, "F", False, "t", True, False, None, None, None)]
    declared = spark.createDataFrame(rows, "page_no long, font long, name string, embedded boolean, program string, type3 boolean, builtin boolean, weight long, style string, legacy string")
    got = {(r.page_no, r.face): (r.embedded, r.several, r.usable) for r in fonts.reconcile_fonts(declared, spark.createDataFrame([(2,)], "page_no long")).collect()}
    assert got == {(1, "A"): ("true", False, True), (1, "B"): ("false", False, False), (1, "C"): ("true", True, True), (1, "D"): ("true", True, True), (1, "E"): ("unknown", False, False), (2, "A"): ("unknown", False, False), (3, "F"): ("false", False, True)}


def test_plain_names_of_fonts_do_not_reach_python(spark):
    files = spark.createDataFrame([(1, "Noto Sans", "Noto Sans Bold", 700, False), (2, "Gro\u0308tesk", "Gro\u0308tesk", 400, False)], "file_id long, family string, full_name string, weight int, italic boolean")
    declared = spark.createDataFrame([(1, "noto-sans,Bold", None, None), (2, "GR\u00d6TESK", None, None)], "font_id long, name string, weight int, italic boolean")
    assert {(r.font_id, r.file_id) for r in fonts.match_font_file(declared, files).collect()} == {(1, 1), (2, 2)}


def test_ambiguous_glyph_is_missing(spark):
    seen = spark.createDataFrame([(1, 65, 7), (1, 65, 8), (1, 66, 9)], "font long, cp long, gid long")
    used = spark.createDataFrame([(1, 65), (1, 66), (1, 67)], "font long, cp long")
    assert {r.cp for r in fonts.missing_glyphs(used, fonts.glyph_coverage(seen)).collect()} == {65, 67}


def test_anchor_contexts(spark):
    docs = spark.createDataFrame([(1, 1, "x" * 200 + "VALUE" + "y" * 10)], "doc_id long, source_id long, text string")
    place = spark.createDataFrame([(9, 1, 1, 200, 5)], "anchor_id long, doc_id long, source_id long, at long, length long")
    anchor = regions.capture_anchor(place, docs)
    row = anchor.first()
    assert (len(row.before), row.after, row.tail) == (128, "y" * 10, 10)
    assert regions.resolve_anchor(anchor, docs).first().reason is None
    twice = docs.unionByName(docs)
    assert regions.resolve_anchor(anchor, twice).first().reason == "paragraph"


def test_places_are_the_same_on_both_ways(spark, sf):
    from quire.plans.regions import places

    one, two = places(spark, sf), places(spark, sf, 0)
    assert one.count() > 0 and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_of_a_line_normalise_in_its_row(spark, sf):
    """Over batches of a few rows, with empty texts, null styles and an empty line: the rows of the row-wise form."""
    from quire.plans.spans import t6_normalize_runs

    assert "Exchange" not in plan(t6_normalize_runs(spark, sf)) and "Window" not in plan(t6_normalize_runs(spark, sf))
    rows = [(n, 0, [(("e", "́x", "", "a b\r", "\n")[(n + k) % 5], (True, None, False)[(n * k) % 3]) for k in range(n % 7)]) for n in range(60)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no long, runs array<struct<text string, bold boolean>>")
    runs = lines.select("doc_id", "line_no", F.posexplode("runs").alias("run_no", "r")).select("doc_id", "line_no", "run_no", "r.text", "r.bold")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = sorted(map(str, spans.normalize_lines(lines.coalesce(1)).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got == sorted(map(str, spans.normalize_runs(runs).collect()))
    assert {r.doc_id for r in spans.normalize_lines(lines).collect()} == {n for n in range(60) if n % 7}


def test_a_cut_stays_in_its_line(spark, sf):
    """At every place of a few runs, in batches of some rows, against a plain splice of letters."""
    from quire.plans.spans import t4_splice_spans

    assert "Exchange" not in plan(t4_splice_spans(spark, sf)) and "Window" not in plan(t4_splice_spans(spark, sf))
    pieces = [[], [("", True)], [("ab", True), ("", False), ("é😀c", False), ("d", True)], [("", None), ("xy", None), ("", True)]]
    cuts = [(n, a, b, new) for n, runs in enumerate(pieces) for a in range(sum(len(t) for t, _ in runs) + 1) for b in range(a, sum(len(t) for t, _ in runs) + 1) for new in ("", "NEW")]
    lines = spark.createDataFrame([(k, n, pieces[n], a, b, new) for k, (n, a, b, new) in enumerate(cuts)], "doc_id long, line_no long, runs array<struct<text string, bold boolean>>, cut_begin long, cut_stop long, inserted string")
    got = {r.doc_id: [(p.begin, p.stop, p.text, p.style) for p in r.runs] for r in spans.splice_lines(lines.coalesce(1)).collect()}
    assert set(got) == {k for k, (n, *_) in enumerate(cuts) if n}
    for k, (n, a, b, new) in enumerate(cuts):
        if n:
            begins = [sum(len(t) for t, _ in pieces[n][:i]) for i in range(len(pieces[n]))]
            style = [s for (_, s), begin in zip(pieces[n], begins) if begin <= a][-1]
            letters = [(c, s) for t, s in pieces[n] for c in t]
            found = []
            for c, s in [*letters[:a], *((c, style) for c in new), *letters[b:]]:
                if found and found[-1][1] == s:
                    found[-1][0] += c
                else:
                    found.append([c, s])
            found = found or [["", style]]
            stops = [sum(len(t) for t, _ in found[: i + 1]) for i in range(len(found))]
            assert got[k] == [(stop - len(t), stop, t, s) for (t, s), stop in zip(found, stops)], cuts[k]


def test_documents_are_searched_once_for_anchors(spark, sf):
    """What t10 returns reads written places and anchors: no step searches the documents again, or deals their texts."""
    from quire.plans.regions import t10_rebase_anchors

    found = t10_rebase_anchors(spark, sf)
    assert found.count() > 0 and not [f for f in found.inputFiles() if "documents.parquet" in f]
    assert "regexp_extract_all" not in plan(found)


def test_a_paragraph_of_no_anchor_does_not_change_its_reasons(spark):
    docs = spark.createDataFrame([(1, 1, "one two three"), (1, 2, "x"), (1, 2, "x"), (2, 1, "a"), (2, 1, "b")], "doc_id long, source_id long, text string")
    places = spark.createDataFrame([(1, 1, 1, 0, 3), (2, 1, 1, 8, 5), (3, 2, 1, 0, 1)], "anchor_id long, doc_id long, source_id long, at long, length long")
    anchors = regions.capture_anchor(places, docs.dropDuplicates(["doc_id", "source_id"]))
    edits_ = spark.createDataFrame([(1, 1, "four"), (2, 3, "c")], "doc_id long, anchor_id long, value string")
    rebased, refused = regions.rebase_anchors(anchors, docs, edits_)
    assert sorted((r.anchor_id, r.at, r.length, r.tail, r.before, r.after) for r in rebased.collect()) == [(1, 0, 4, 10, "", " two three"), (2, 9, 5, 0, "four two ", "")]
    assert [(r.doc_id, r.reason) for r in refused.collect()] == [(2, "unresolved")]

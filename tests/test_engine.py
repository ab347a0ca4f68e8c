"""The engine on small fixtures: a release of three concepts, a graph of ten, chains, code lists, searches."""

import random

import pytest
from pyspark.sql import functions as F

from termloom.functions import scalars as fn
from termloom.operators import build as B
from termloom.operators import codelists as C
from termloom.operators import compare as D
from termloom.operators import hierarchy as H
from termloom.operators import lookup as L
from termloom.operators import search as S
from termloom.operators import sinks as K
from termloom.operators import vectors as V
from termloom.plans import expressions as E
from termloom.plans.terminology import Terminology
from termloom.schema import CONCEPT, CTV3_MAP, FSN_TYPE, IS_A, PREFERRED, SYNONYM_TYPE
from termloom.sources import records as R
from termloom.sources import release

CONCEPT_HEAD = "id\teffectiveTime\tactive\tmoduleId\tdefinitionStatusId"


def write(folder, name, *rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join("\t".join(map(str, r)) for r in rows) + "\n")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("release") / "Snapshot"
    ids = ["138875005", "404684003", "386661006"]
    write(at, "sct2_Concept_Snapshot_X.txt", CONCEPT_HEAD.split("\t"), *[[i, "20020131", 1, "m", "d"] for i in ids], ["99", "20020131", 0, "m", "d"], ["55", "20020131", 1, "m", "d"])
    d = lambda i, c, t, term, lang="en", on=1: [i, "20020131", on, "m", c, lang, t, term, "x"]
    write(
        at, "sct2_Description_Snapshot-en_X.txt", "id effectiveTime active moduleId conceptId languageCode typeId term caseSignificanceId".split(),
        d(1, ids[0], FSN_TYPE, "Top concept (root)"), d(2, ids[1], FSN_TYPE, "Clinical finding (finding)"), d(3, ids[2], FSN_TYPE, "Fever (finding)"),
        d(4, ids[2], SYNONYM_TYPE, "Pyrexia"), d(5, ids[2], SYNONYM_TYPE, "Fievre", "fr"), d(6, ids[2], SYNONYM_TYPE, '"Hot ""x"" temp"'), d(7, "99", FSN_TYPE, "Gone (x)"), d(8, "55", FSN_TYPE, "Orphan (x)"),
    )
    r = lambda s, t, kind=IS_A, on=1: ["r", "20020131", on, "m", s, t, 0, kind, "c", "o"]
    write(
        at, "sct2_Relationship_Snapshot_X.txt", "id effectiveTime active moduleId sourceId destinationId relationshipGroup typeId characteristicTypeId modifierId".split(),
        r(ids[1], ids[0]), r(ids[2], ids[1]), r(ids[2], ids[0]), r(ids[2], ids[1], "363698007"), r(ids[2], "777", "123"), r("99", ids[0], IS_A, 1), r(ids[1], "99", IS_A, 0),
    )
    write(at, "sct2_StatedRelationship_Snapshot_X.txt", ["id"], ["bad"])
    write(at, "der2_cRefset_LanguageSnapshot-en_X.txt", "id effectiveTime active moduleId refsetId referencedComponentId acceptabilityId".split(), ["a", "x", 1, "m", "r", 4, PREFERRED], ["b", "x", 1, "m", "r", 5, PREFERRED], ["c", "x", 1, "m", "r", 6, "other"])
    write(at, "der2_sRefset_SimpleMapSnapshot_X.txt", "id effectiveTime active moduleId refsetId referencedComponentId mapTarget".split(), ["a", "x", 1, "m", CTV3_MAP, ids[2], " X76tE "], ["b", "x", 1, "m", CTV3_MAP, ids[2], ""], ["c", "x", 1, "m", CTV3_MAP, ids[2], "B1"])
    write(at, "der2_Refset_SimpleSnapshot_X.txt", "id effectiveTime active moduleId refsetId referencedComponentId".split(), ["a", "x", 1, "m", "S1", ids[2]], ["b", "x", 1, "m", "S1", ids[2]], ["c", "x", 1, "m", "S1", "99"])
    df = B.build(release.read_release(spark, [str(at.parent)])).cache()
    return {r.id: r for r in df.collect()}, df


def test_build_records(built):
    rows, df = built
    assert set(rows) == {"138875005", "404684003", "386661006", "55"} and [f.name for f in df.schema] == [f.name for f in CONCEPT]
    fever = rows["386661006"]
    assert fever.preferred_term == "Pyrexia" and fever.synonyms == ["Fievre", 'Hot "x" temp'] and fever.hierarchy == "Clinical finding"
    assert fever.hierarchy_path == ["Top concept", "Clinical finding", "Fever"] and fever.schema_version == 3
    assert [(p.id, p.fsn) for p in fever.parents] == [("138875005", "Top concept (root)"), ("404684003", "Clinical finding (finding)")]
    assert {k: [x.id for x in v] for k, v in fever.attributes.items()} == {"finding_site": ["404684003"], "123": ["777"]}
    assert fever.ctv3_codes == ["B1", "X76tE"] and fever.refsets == ["S1"] and fever.read2_codes == []
    assert rows["404684003"].children_count == 1 and rows["138875005"].children_count == 3  # edges from anything count
    assert rows["55"].hierarchy == "" and rows["55"].hierarchy_path == ["Orphan"] and rows["55"].preferred_term == "Orphan"


def test_layers_and_retraction(spark):
    c = spark.createDataFrame([("1", True, "a", 1), ("1", False, "b", 2), ("2", True, "a", 1), ("2", True, "b", 2)], "id string, active boolean, v string, ord int")
    assert sorted((r.id, r.v) for r in B.active_concepts(c).collect()) == [("1", "a"), ("2", "b")]
    assert [r.id for r in B.active_concepts(c, retract=True).collect()] == ["2"]
    assert len(B.active_concepts(c, include_inactive=True).collect()) == 2


def test_ragged_row_is_an_error(spark, tmp_path):
    write(tmp_path, "sct2_Concept_Snapshot_X.txt", CONCEPT_HEAD.split("\t"), ["1", "x", 1, "m", "d"], ["2", "x"])
    with pytest.raises(Exception):
        release.read_kind(spark, "concept", [str(tmp_path / "sct2_Concept_Snapshot_X.txt")]).collect()


def test_ndjson_and_parquet_round_trip(spark, built, tmp_path):
    rows, df = built
    K.write_ndjson(df, str(tmp_path / "n"))
    K.write_parquet(df, str(tmp_path / "p"))
    K.write_parquet(df, str(tmp_path / "f"), nested=False)
    want = {i: r.asDict(True) for i, r in rows.items()}
    assert {r.id: r.asDict(True) for r in R.read_ndjson(spark, str(tmp_path / "n")).collect()} == want
    assert {r.id: r.asDict(True) for r in R.read_parquet(spark, str(tmp_path / "p")).collect()} == want
    flat = {r.id: r.asDict(True) for r in R.read_parquet(spark, str(tmp_path / "f")).collect()}
    assert all(flat[i]["parents"] == want[i]["parents"] and flat[i]["attributes"] == want[i]["attributes"] and flat[i]["refsets"] == [] for i in want)
    assert R.check_version(df) == "ok" and R.check_version(df.limit(0)) == "empty"
    with pytest.raises(ValueError):
        R.check_version(df.withColumn("schema_version", F.lit(9)))
    ids = [r.value for r in spark.read.text(str(tmp_path / "n")).collect()]
    assert len(ids) == 4
    assert K.write_markdown(df, str(tmp_path / "m")).agg(F.sum("files")).first()[0] == 4
    assert (tmp_path / "m" / "clinical-finding" / "386661006.md").read_text().startswith("# Pyrexia\n\n**SCTID:** 386661006  \n")


GRAPH = [("1000000", "Root concept", "root", None, []), ("2000000", "Clinical finding", "clinical_finding", "1000000", ["Finding"]), ("3000000", "Diabetes mellitus", "clinical_finding", "2000000", ["DM", "Diabetes"]), ("4000000", "Type 1 diabetes mellitus", "clinical_finding", "3000000", []), ("5000000", "Type 2 diabetes mellitus", "clinical_finding", "3000000", []), ("6000000", "Heart disease", "clinical_finding", "2000000", ["Cardiac disease"]), ("7000000", "Myocardial infarction", "clinical_finding", "6000000", ["Heart attack", "MI"]), ("8000000", "Heart failure", "clinical_finding", "6000000", []), ("9000000", "Procedure", "procedure", "1000000", []), ("10000000", "Cardiac procedure", "procedure", "9000000", [])]


@pytest.fixture(scope="module")
def ten(spark):
    """Ten concepts, each edge six times."""
    up = {i: p for i, _, _, p, _ in GRAPH}
    term = {i: t for i, t, *_ in GRAPH}

    def path(i):
        return (path(up[i]) if up[i] else []) + [term[i]]

    rows = [(i, f"{t} ({h})", t, s, h, path(i), [(p, term[p])] if p else [], sum(x == i for x in up.values()), True, "m", "20240101", {}, ["X200E"] if i == "7000000" else [], [], [], 3) for i, t, h, p, s in GRAPH]
    isa = spark.createDataFrame([(i, p) for i, _, _, p, _ in GRAPH if p] * 6, "child_id string, parent_id string")
    return Terminology(spark.createDataFrame(rows, CONCEPT).cache(), isa.cache())


def ids(df):
    return [r.id for r in df.collect()]


def test_children_and_ancestors_once_each(ten):
    assert ids(ten.children("3000000")) == ["4000000", "5000000"] and ids(ten.children("4000000")) == []
    assert ids(ten.ancestors("4000000")) == ["3000000", "2000000", "1000000"]
    assert sorted(ids(ten.descendants("6000000"))) == ["7000000", "8000000"]
    assert ids(ten.hierarchy("procedure")) == ["10000000", "9000000"]


def test_search_and_maps(ten):
    assert ids(ten.search("myocardial")) == ["7000000"] and ids(ten.search("Heart attack")) == ["7000000"]
    assert set(ids(ten.search("Heart OR Diabetes"))) == {"3000000", "4000000", "5000000", "6000000", "7000000", "8000000"}
    assert set(ids(ten.search("Heart NOT attack"))) == {"6000000", "8000000"} and set(ids(ten.search("card*"))) == {"6000000", "10000000"}
    assert ids(ten.map_to("X200E", "ctv3")) == ["7000000"] and [r.code for r in ten.map_from("7000000", "ctv3").collect()] == ["X200E"]
    assert ids(ten.concept("X200E")) == ["7000000"] and ids(ten.concept("7000000")) == ["7000000"]
    with pytest.raises(ValueError):
        ten.map_to("x", "icd")


def test_expressions(ten):
    one = lambda e: set(ids(ten.select(e)))
    assert one("descendants of Heart disease including self") == {"6000000", "7000000", "8000000"}
    assert one("children of 2000000 or (parents of 4000000)") == {"3000000", "6000000"}
    assert one("descendants of 2000000 excluding descendants of 6000000 and children of 3000000") == {"4000000", "5000000"}
    assert E.constraint("descendants of 2 including self excluding (children of 3 where finding site is any)") == "<< 2 MINUS (<! 3 : finding_site = *)"
    with pytest.raises(LookupError):
        ten.select("descendants of nothing at all")
    assert ten.subsumption("3000000", "4000000").first()[0] == "subsumes" and ten.subsumption("4000000", "3000000").first()[0] == "subsumed-by"
    assert ten.subsumption("4000000", "8000000").first()[0] == "not-subsumed" and ten.subsumption("4", "4").first()[0] == "equivalent"
    assert ids(ten.expand("descendants of 1000000", "heart", 0, 5)) == ["6000000", "8000000", "7000000"]
    pairs = ten.concepts.sparkSession.createDataFrame([("7000000", "6000000"), ("6000000", "7000000"), ("6000000", "6000000")], "a string, b string")
    assert {(r.a, r.b): r.subsumed for r in ten.is_a(pairs).collect()} == {("7000000", "6000000"): True, ("6000000", "7000000"): False, ("6000000", "6000000"): False}


def closure_by_walk(edges):
    up = {}
    for c, p in edges:
        if c != p:
            up.setdefault(c, set()).add(p)
    out = {}
    for start in up:
        seen, layer, depth = {start}, {start}, 0
        while layer:
            depth += 1
            layer = {p for c in layer for p in up.get(c, ())} - seen
            seen |= layer
            out |= {(p, start): depth for p in layer}
    return out


def test_closure_on_random_graphs_with_cycles(spark):
    for seed in range(3):
        r = random.Random(seed)
        edges = [(str(r.randint(0, 14)), str(r.randint(0, 14))) for _ in range(25)]
        edges += edges[:6]
        got = H.closure(spark.createDataFrame(edges, "child_id string, parent_id string"))
        assert {(x.ancestor_id, x.descendant_id): x.depth for x in got.collect()} == closure_by_walk(edges)


def test_deep_chain_does_not_explode(spark):
    chain = spark.createDataFrame([(str(i + 1), str(i)) for i in range(24)] * 6, "child_id string, parent_id string")
    seeds = spark.createDataFrame([("24",)], "id string")
    assert H.reachable(chain, seeds, down=False).count() == 24


def test_release_comparison(spark):
    rec = "id string, preferred_term string, hierarchy string, active boolean"
    old = spark.createDataFrame([("1", "Fever", "F", True), ("2", "A", "F", True), ("3", "B", "F", True), ("4", "C", "F", False), ("5", "D", "F", True)], rec)
    new = spark.createDataFrame([("1", "Pyrexia", "G", True), ("2", "A", "F", False), ("4", "C", "F", True), ("5", "D", "F", True), ("6", "E", "F", True), ("7", "X", "F", False)], rec)
    got = [(r.change, r.id) for r in D.ordered(D.compare(old, new)).collect()]
    assert got == [("added", "6"), ("inactivated", "2"), ("inactivated", "3"), ("preferred_term_changed", "1"), ("hierarchy_changed", "1")]


BODY = ["100100100      Sprained ankle (injury)", "20020020       Twisted knee (injury)  # both sides", "# 30030030      Sore elbow (injury)", "# ? 400400400   Stiff wrist (injury)", "# -- limbs --", ""]


def test_codelist_file(spark, tmp_path):
    head = C.new("Joint list", "X CT", today="2024-01-01").split("\n---\n")[0]
    (tmp_path / "a.codelist").write_text("﻿" + head + "\n---\n\n" + "\n".join(BODY) + "\n")
    (tmp_path / "bad.codelist").write_text("no header")
    files = C.read(spark, str(tmp_path))
    errors = {r.file.rsplit("/", 1)[1]: r.error for r in files.collect()}
    assert errors["a.codelist"] is None and "start with" in errors["bad.codelist"]
    rows = C.classified(C.lines(files)).orderBy("line_no").collect()
    assert [r.kind for r in rows] == ["active", "active", "excluded", "pending", "comment", "blank"] or [r.kind for r in rows] == ["active", "active", "excluded", "pending", "comment"]
    assert rows[1].comment == "both sides" and rows[3].code == "400400400" and rows[3].term == "Stiff wrist (injury)"
    fields = C.fields(files.where("error is null").first().header)
    assert fields["title"] == "Joint list" and ("warning", "misuse") in C.header_problems(fields)
    df = C.classified(C.lines(files))
    text = C.document(head.removeprefix("---\n"), df.select("line_no", "kind", "code", "term", "comment")).first().text
    assert "100100100      Sprained ankle (injury)\n" in text and "# 30030030      Sore elbow (injury)" in text
    out = {r.code: (r.kind, r.comment) for r in C.removed(df, "20020020", "why").collect() if r.code}
    assert out["20020020"] == ("excluded", "why") and out["100100100"] == ("active", None)
    with pytest.raises(Exception):
        C.removed(df, "1").collect()
    md = [r.line for r in C.exported(df, "markdown", fields).orderBy("line_no").collect()]
    assert md[0] == "# Joint list" and md[-1] == "| `20020020` | Twisted knee (injury) |"


def test_scalars(spark):
    df = spark.createDataFrame([("Fever (finding)",), ("No tag",), ("Multi (word) (tag)",), ("open (x",), ("",)], "s string")
    got = [(r.a, r.b) for r in df.select(fn.strip_tag(F.col("s")).alias("a"), fn.semantic_tag(F.col("s")).alias("b")).collect()]
    assert got == [("Fever", "finding"), ("No tag", ""), ("Multi (word)", "tag"), ("open", ""), ("", "")]
    line = lambda pt, fsn, t, **k: spark.range(1).select(fn.rendered({"id": F.lit("1"), "pt": F.lit(pt), "fsn": F.lit(fsn), "hierarchy": F.lit("H")} | {a: F.lit(b) for a, b in k.items()}, *t)).first()[0]
    assert line("Fever", "Fever (finding)", ()) == "1 | Fever (H)" and line("Pyrexia", "Fever (finding)", ()) == "1 | Pyrexia (H) - FSN: Fever"
    assert line("x", "", ("{nope} {id} {open", "")) == "{nope} 1 {open" and line("x", "", ("{count}/{score}/{tag}", ""), score=0.91234) == "/0.9123/"
    assert fn.date_in_name("b7-19981224x.json") == "1998-12-24" and fn.date_in_name("x-99999999.txt") is None
    assert fn.path_slug("/a/Big_Edition 2.ZIP") == "big-edition-2"
    assert S.sanitised("heart attack") == '"heart attack"' and S.sanitised("heart AND attack") == "heart AND attack" and S.sanitised("myo*") == "myo*"
    assert S.sanitised("  asthma ", "mcp") == "asthma" and S.sanitised('a "b" c', "mcp") == '"a ""b"" c"' and S.sanitised("  ", "mcp") == "" and S.sanitised("hea", "ui") == "hea*"
    assert L.capped(-1, 10) is None and L.capped(50, 10) == 10


def test_vectors(spark, tmp_path):
    e = spark.createDataFrame([("a", "A", "h", [1.0, 0.0]), ("b", "B", "h", [0.0, 2.0]), ("c", "C", "g", [3.0, 4.0]), ("z", "Z", "g", [0.0, 0.0])], "id string, preferred_term string, hierarchy string, embedding array<float>")
    got = [(r.id, round(r.similarity, 3)) for r in V.nearest(e, [1.0, 0.0]).collect()]
    assert got == [("a", 1.0), ("c", 0.6), ("b", 0.0), ("z", 0.0)]
    with pytest.raises(Exception):
        V.nearest(e, [1.0, 0.0, 0.0]).collect()
    assert K.write_arrow(e, str(tmp_path / "e.arrow")) == 4
    assert R.read_embeddings(spark, str(tmp_path / "e.arrow"), 2).count() == 4
    with pytest.raises(ValueError):
        R.read_embeddings(spark, str(tmp_path / "e.arrow"), 3)
    res = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (2, "b", 0.9), (2, "a", 0.1)], "query_id int, id string, similarity double")
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (3, "q")], "query_id int, id string")
    m = V.retrieval_figures(res, truth).first()
    assert round(m.top_1, 3) == 0.333 and round(m.top_5, 3) == 0.667 and round(m.mrr, 3) == 0.5


def test_stream_keeps_the_latest_record(spark, built, tmp_path):
    from termloom.streaming import ingest

    _, df = built
    K.ndjson_lines(df).write.text(str(tmp_path / "in" / "a"))
    (tmp_path / "drop").mkdir()
    for k, text in enumerate(["\n".join(r.value for r in spark.read.text(str(tmp_path / "in" / "a")).collect())]):
        (tmp_path / "drop" / f"{k}.json").write_text(text)
    table = str(tmp_path / "table")
    ingest.keep_latest(ingest.stream_records(spark, str(tmp_path / "drop")), table, str(tmp_path / "cp")).awaitTermination()
    newer = df.where("id = '55'").withColumn("effective_time", F.lit("20300101")).withColumn("preferred_term", F.lit("Changed"))
    (tmp_path / "drop" / "9.json").write_text(K.ndjson_lines(newer).first().value)
    ingest.keep_latest(ingest.stream_records(spark, str(tmp_path / "drop")), table, str(tmp_path / "cp")).awaitTermination()
    now = {r.id: r.preferred_term for r in ingest.current(spark, table, 1).collect()}
    assert len(now) == 4 and now["55"] == "Changed" and now["386661006"] == "Pyrexia"


def test_stream_writes_what_a_batch_touches_and_counts_late_rows(spark, built, tmp_path):
    import datetime as dt

    from termloom.streaming import ingest

    _, df = built
    (tmp_path / "drop").mkdir()
    table = str(tmp_path / "table")
    for k, (term, when) in enumerate([("a", "20200101"), ("b", "20300101"), ("stale", "20100101"), ("d", "20300101")]):
        rows = df if k == 0 else df.where("id = '55'").withColumn("preferred_term", F.lit(term)).withColumn("effective_time", F.lit(when))
        (tmp_path / "drop" / f"{k}.json").write_text("\n".join(r.value for r in K.ndjson_lines(rows).collect()))
        ingest.keep_latest(ingest.stream_records(spark, str(tmp_path / "drop")), table, str(tmp_path / "cp")).awaitTermination()
    now = {r.id: r.preferred_term for r in ingest.current(spark, table, 3).collect()}
    assert len(now) == 4 and now["55"] == "d" and now["386661006"] == "Pyrexia"
    versions = ingest._listed(spark, table)
    assert {v for _, v in versions} == {0, 2, 3} and len([1 for _, v in versions if v]) == 2  # one bucket was written again, its oldest are gone
    same = df.where("id = '55'").select("*").unionAll(df.where("id = '55'").withColumn("preferred_term", F.lit("tie")))
    assert len({ingest.merged(None, x).first().preferred_term for x in (same, same.orderBy("preferred_term"), same.orderBy(F.desc("preferred_term")))}) == 1

    day = dt.datetime(2024, 1, 5)
    events = [("a", day, 1.0), ("a", day + dt.timedelta(hours=5), 2.0), ("b", day + dt.timedelta(days=1), 3.0), ("a", day + dt.timedelta(days=9), 0.0)]
    spark.createDataFrame(events, "event_type string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(str(tmp_path / "ev"))
    q = ingest.counts_by_time(stream, "ts").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.window.start, r.event_type): (r.n, r.total) for r in spark.table("counted").collect()} == {(day, "a"): (2, 3.0), (day + dt.timedelta(days=1), "b"): (1, 3.0), (day + dt.timedelta(days=9), "a"): (1, 0.0)}


def test_releases_need_concepts_and_records_their_fields(spark, tmp_path, built):
    (tmp_path / "empty").mkdir()
    for where in (str(tmp_path / "empty"), str(tmp_path / "nowhere")):
        with pytest.raises(FileNotFoundError):
            release.read_release(spark, [where])
    with pytest.raises(ValueError):
        release.read_release(spark, [], refsets="all")
    write(tmp_path / "in", "sct2_Concept_Snapshot_X.txt", CONCEPT_HEAD.split("\t"), ["1", "x", 1, "m", "d"])
    assert release.discover(f"file://{tmp_path}/in", spark)["concept"] == [f"file:{tmp_path}/in/sct2_Concept_Snapshot_X.txt"]
    assert release.read_release(spark, [f"file://{tmp_path}/in"])["concept"].count() == 1
    _, df = built
    line = K.ndjson_lines(df.where("id = '55'")).first().value
    (tmp_path / "good.json").write_text(line + "\n\n")
    assert R.read_ndjson(spark, str(tmp_path / "good.json")).count() == 1
    import json

    short = {k: v for k, v in json.loads(line).items() if k != "module"}
    (tmp_path / "bad.json").write_text(json.dumps(short))
    with pytest.raises(Exception, match="lacks module"):
        R.read_ndjson(spark, str(tmp_path / "bad.json")).collect()


def test_repeated_ids_of_a_release_count_once(spark):
    rec = "id string, preferred_term string, hierarchy string, active boolean, ord int"
    old = spark.createDataFrame([("1", "A", "F", True, 1), ("1", "B", "F", True, 2)], rec)
    new = spark.createDataFrame([("1", "C", "F", True, 2), ("1", "B", "F", True, 3), ("2", "N", "F", True, 1), ("2", "N", "F", True, 2)], rec)
    assert [(r.change, r.id) for r in D.compare(old, new).collect()] == [("added", "2")]
    assert [r.line for r in D.report(old, new).collect()] == ["Added: 1", "  2 N", "Inactivated: 0", "Terms changed: 0", "Hierarchies changed: 0"]


def test_settings_and_paths(tmp_path):
    (tmp_path / "a.toml").write_text("[x]\ny = 1\n")
    (tmp_path / "b.toml").write_text("= no")
    assert R.read_config(str(tmp_path / "a.toml")) == {"x": {"y": 1}} and R.read_config(str(tmp_path / "b.toml")) == {} and R.read_config(str(tmp_path / "c.toml")) == {}
    here = str(tmp_path / "a.toml")
    assert R.resolve_path(here, "/no", None) == here and R.resolve_path(None, "/no", here) == here
    for explicit, env in (("/no/such", here), (None, None)):
        with pytest.raises(FileNotFoundError):
            R.resolve_path(explicit, "/no", env)


def test_emitted_sql_equals_frames(ten):
    ten.closed  # noqa: B018
    ten.register()
    spark = ten.concepts.sparkSession
    for e in ("descendants of Heart disease including self", "children of 2000000 or (parents of 4000000)", "descendants of 2000000 excluding descendants of 6000000", "ancestors of 4000000 and ancestors of 5000000"):
        assert {r.id for r in spark.sql(ten.sql(e)).collect()} == {r.id for r in ten.select(e).collect()}
    assert [(r.depth, r.id) for r in ten.chain("4000000").collect()] == [(1, "3000000"), (2, "2000000"), (3, "1000000")]
    assert ids(ten.ancestors("4000000")) == ["3000000", "2000000", "1000000"] and sorted(ids(ten.descendants("6000000"))) == ["7000000", "8000000"]


def test_new_list_warns_by_terminology(spark):
    head = lambda t, **k: C.new("Joint list", t, **k).split("\n---\n")[0].removeprefix("---\n")
    got = {t: [(w.code, w.severity) for w in spark.createDataFrame([(head(t),)], "h string").select(C.warnings(F.col("h"))).first()[0]] for t in ("X", "SNOMED CT", "dm+d")}
    assert got["X"] == [("not-universal-definition", "info"), ("draft-not-reviewed", "info")] and got["SNOMED CT"][2:] == [("snomed-release-age", "caution")] and got["dm+d"][2:] == [("dmd-currency", "warning"), ("dmd-vmp-code-change", "caution")]
    assert C.fields(head("X", release="20240101"))["snomed_release"] == "20240101"


def test_closure_order_of_partitions_does_not_matter(built):
    _, df = built
    isa = B.edges_of(df)
    a = sorted(map(tuple, H.closure(isa).collect()))
    assert a == sorted(map(tuple, H.closure(isa.repartition(3, F.rand(1))).collect()))


def test_artefacts_and_catalogue(spark, built, tmp_path):
    from termloom.plans import artefacts
    from termloom.sources import catalogue

    _, df = built
    at = tmp_path / "rel"
    write(at, "sct2_Concept_Snapshot_X.txt", CONCEPT_HEAD.split("\t"), ["1", "x", 1, "m", "d"], ["2", "x", 1, "m", "d"])
    write(at, "sct2_Description_Snapshot-en_X.txt", "id effectiveTime active moduleId conceptId languageCode typeId term caseSignificanceId".split(), ["1", "x", 1, "m", "1", "en", FSN_TYPE, "Top (t)", "c"], ["2", "x", 1, "m", "2", "en", FSN_TYPE, "Low thing (t)", "c"])
    write(at, "sct2_Relationship_Snapshot_X.txt", "id effectiveTime active moduleId sourceId destinationId relationshipGroup typeId characteristicTypeId modifierId".split(), ["r", "x", 1, "m", "2", "1", 0, IS_A, "c", "o"])

    def fails(texts):
        raise RuntimeError("no model here")

    paths = artefacts.make(spark, [str(at)], str(tmp_path / "out"), model=fails, root="1")
    assert "embeddings" not in paths and "no model here" in paths["embeddings_error"]
    t = artefacts.load(spark, paths)
    assert ids(t.search("low thing")) == ["2"] and ids(t.select("descendants of 1")) == ["2"] and t.concept("2").first().hierarchy == "Low thing"
    assert {r.name: r.value for r in artefacts.info(t.concepts).collect()}["total"] == "2"
    good = V.embedded(t.concepts, lambda texts: [[float(len(x)), 1.0] for x in texts], 1).collect()
    assert len(good) == 2 and len(good[0].embedding) == 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.zip").write_bytes(b"abc")
    rows = [("uk", "a.zip", "20240101", "u", "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD".lower()), ("uk", "b.zip", "20250101", "u", "00")]
    c = spark.createDataFrame(rows, catalogue.SCHEMA)
    assert [r.name for r in catalogue.newer(c, spark.createDataFrame([("uk", "20240101")], "edition string, release_date string")).collect()] == ["b.zip"]
    assert [(r.name, r.good) for r in catalogue.verified(spark, str(tmp_path / "f"), c).collect()] == [("a.zip", True)]
    import zipfile

    with zipfile.ZipFile(tmp_path / "Rel.ZIP", "w") as z:
        z.writestr("top/Snapshot/x.txt", "1")
        z.writestr("../evil.txt", "2")
    assert release.unpacked(str(tmp_path / "Rel.ZIP"), str(tmp_path / "stage")).endswith("top") and not (tmp_path / "stage" / "evil.txt").exists() and not (tmp_path / "evil.txt").exists()


SMALL = "/root/testdata/sf0.001"


def test_lookups_and_closures_of_the_whole_table(spark):
    from termloom import surrogate
    from termloom.queries.terminology import Q

    got = lambda name: sorted(tuple(r) for r in Q[name](spark, SMALL).collect())
    name = {f"P{r.p_partkey}": f"{r.p_name} (part)" for r in spark.read.parquet(f"{SMALL}/part.parquet").collect()}
    asked = {f"P{r.l_partkey}" for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").collect()}
    assert len(asked) > 50 and got("bulk_lookup") == sorted((i, name[i]) for i in asked if i in name)

    t = surrogate.terminology(spark, SMALL)
    ids_ = [r.id for r in t.concepts.select("id").collect()]
    edges = [(r.child_id, r.parent_id) for r in t.isa.select("child_id", "parent_id").collect()]
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    closed = {}
    for i in ids_:
        level, depth = {i}, 0
        while level:
            for x in level:
                closed.setdefault((x, i), depth)
            level, depth = {p for x in level for p in up.get(x, ()) if (p, i) not in closed}, depth + 1
    assert got("closure_self") == sorted((*k, d) for k, d in closed.items())
    assert got("subsumes") == sorted((c, b, c != b and (b, c) in closed) for c, p in edges for b in ("R1", "PART", c, p))
    below = {}
    for a, _ in closed:
        below[a] = below.get(a, 0) + 1
    assert got("descendants_or_self_counts") == sorted((i, below[i]) for i in ids_)


def test_vector_search_of_many(spark):
    import numpy as np

    from termloom.queries.terminology import Q

    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for i, r in enumerate(rows):
        if r.vec_id % 50 == 0:
            s = v @ v[i]
            want[r.vec_id] = [round(float(x), 5) for x in sorted(s, reverse=True)[:10]]
    got = {}
    for r in Q["cosine_topk_batch"](spark, SMALL).collect():
        got.setdefault(r.query_id, []).append(r.similarity)
    assert len(got) > 1 and got.keys() == want.keys()
    assert all(np.allclose(sorted(got[k], reverse=True), want[k], atol=2e-5) and len(got[k]) == 10 for k in want)


def test_pages_of_all_concepts_and_hierarchies(spark):
    import hashlib

    from termloom import surrogate
    from termloom.queries.terminology import Q

    records = [r.asDict(recursive=True) for r in surrogate.terminology(spark, SMALL).concepts.collect()]
    bare = lambda fsn: fsn.rpartition(" (")[0] if " (" in fsn else fsn
    human = lambda k: (x := k.replace("_", " "))[:1].upper() + x[1:]

    def page(r):
        path = r["hierarchy_path"]
        out = f"# {r['preferred_term']}\n\n**SCTID:** {r['id']}  \n**FSN:** {r['fsn']}  \n**Hierarchy:** {' > '.join(path[:-1]) if len(path) > 1 else r['hierarchy']}  \n\n"
        if r["synonyms"]:
            out += "## Synonyms\n\n" + "".join(f"- {x}\n" for x in r["synonyms"]) + "\n"
        if r["attributes"]:
            out += "## Relationships\n\n" + "".join(f"- **{human(k)}:** {bare(x['fsn'])} [{x['id']}]\n" for k, v in r["attributes"].items() for x in v) + "\n"
        out += "## Hierarchy\n\n" + "".join("  " * i + (f"- **{x}** *(this concept)*\n" if i == len(path) - 1 else f"- {x}\n") for i, x in enumerate(path))
        return out + ("\n## Parents\n\n" + "".join(f"- {x['fsn']} `{x['id']}`\n" for x in r["parents"]) if r["parents"] else "")

    def section(r):
        out = f"---\n\n## {r['preferred_term']} `{r['id']}`\n\n**FSN:** {r['fsn']}  \n" + (f"**Synonyms:** {', '.join(r['synonyms'])}  \n" if r["synonyms"] else "")
        return out + "".join(f"**{human(k)}:** {', '.join(bare(x['fsn']) for x in v)}  \n" for k, v in r["attributes"].items()) + "\n"

    want = {r["id"]: page(r) for r in records}
    assert {r.id: r.text for r in Q["md_concept"](spark, SMALL).collect()} == want
    assert {i[0] for i in want} >= set("CRPONS") and any("## Synonyms" in x and "## Relationships" in x for x in want.values())
    by = {}
    for r in sorted(records, key=lambda r: r["id"]):
        by.setdefault(r["hierarchy"], []).append(section(r))
    pages = {(h, len(x), hashlib.md5(f"# {h}\n\n> {len(x)} concepts in this hierarchy.\n\n{''.join(x)}".encode()).hexdigest()) for h, x in by.items()}
    assert {tuple(r) for r in Q["md_hierarchy"](spark, SMALL).collect()} == pages and "Part" in by


def test_sizes_of_a_gigabyte_and_more(spark, tmp_path):
    from pathlib import Path

    import duckdb

    from termloom.queries.terminology import SQL, Q

    keys = [1, 2, 3, 2641, 2642, 2704639, 2704640, 5704096, 10**12]  # times 397: around 1 KB, 1 MB and 1 GB
    for p in Path(SMALL).glob("*.parquet"):
        if p.name != "orders.parquet":
            (tmp_path / p.name).symlink_to(p)
    one = spark.read.parquet(f"{SMALL}/orders.parquet").drop("o_orderkey").limit(1)
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").crossJoin(one).write.parquet(f"{tmp_path}/orders.parquet")
    got = Q["sizes_and_thousands"](spark, str(tmp_path)).collect()
    want = duckdb.sql(SQL["sizes_and_thousands"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.size.endswith(" MB") for r in got) > 2
    n = spark.createDataFrame([(1 << 30,)], "n long")
    assert n.select(fn.human_size(F.col("n")), fn.human_size(F.col("n"), gigabytes=False)).first()[:] == ("1.0 GB", "1024.0 MB")


def test_pages_are_never_put_together(spark):
    import hashlib

    from termloom.queries.terminology import Q

    r = random.Random(3)
    rows = [(f"C{i}", f"Name {i} \u00e9 (x)" if i % 17 else None, f"Name {i}", [], "ABC"[i % 3] if i % 20 else None, {}) for i in range(200)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, fsn string, preferred_term string, synonyms array<string>, hierarchy string, attributes map<string,array<struct<id:string,fsn:string>>>").repartition(5)
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a page takes several batches, a batch several pages
    try:
        got = {tuple(x) for x in K.page_digests(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    want = set()
    for h in {x[4] for x in rows}:
        of = sorted((x for x in rows if x[4] == h), key=lambda x: x[0])
        text = "".join(f"---\n\n## {x[2]} `{x[0]}`\n\n**FSN:** {x[1]}  \n\n" for x in of if x[1] is not None)
        want.add((h, len(of), None if h is None else hashlib.md5(f"# {h}\n\n> {len(of)} concepts in this hierarchy.\n\n{text}".encode()).hexdigest()))
    assert got == want
    plan = Q["md_hierarchy"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join(transform(array_sort" not in plan and "MapInArrow" in plan

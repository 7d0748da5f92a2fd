import time
from collections import defaultdict

import pytest
from pyspark.errors import AnalysisException
from conftest import PRODUCT_ROWS, pairs
from pyspark.sql import functions as F

from prismdex.config import IndexConfig
from prismdex.operators import dictionary as D
from prismdex.operators.analysis import Chain, analyze, expand_synonyms
from prismdex.operators.sizing import key_ranges
from prismdex.plans import index as I
from prismdex.plans.search import browse
from prismdex.sources import store, xml_records
from prismdex.sources.documents import assign_ids, to_documents

FREQUENCIES = {
    "america": 4, "atlantic": 4, "bahama": 3, "batten": 3, "board": 3, "composite": 4, "custom": 16, "england": 2,
    "hybrid": 4, "louvered": 6, "mid": 4, "new": 2, "panel": 6, "premium": 4, "raised": 6, "shutters": 18, "southern": 4,
    "standard": 2, "style craft": 10, "stylecraft": 10, "suburban": 4, "vinyl": 4, "wood": 6,
}


def test_postings_and_dictionary(index):
    assert index.postings.agg(F.sum("tf")).first()[0] == 129
    assert dict(pairs(index.frequencies)) == FREQUENCIES
    assert [t for (t,) in pairs(D.term_dictionary(index.postings))] == sorted(FREQUENCIES)


def test_synonyms_stack_on_their_term(index):
    at = defaultdict(set)
    for r in index.postings.where("doc_id = 4").collect():
        at[tuple(r.positions)].add(r.term)
    assert at[(0,)] == {"stylecraft", "style craft"}


def test_lengths(index):
    lengths = {r.doc_id: (r.n_terms, r.n_positions) for r in index.lengths.collect()}
    assert [lengths[d] for d in (0, 4, 6, 7)] == [(6, 6), (9, 8), (7, 6), (8, 7)]


def test_synonyms_are_not_looked_up_again(rows):
    text = rows("doc_id long, pos int, term string", (1, 0, "style"), (1, 1, "x"))
    known = rows("term string, synonym string", ("style", "stylecraft"), ("stylecraft", "style craft"))
    assert pairs(expand_synonyms(text, known)) == [(1, 0, "style"), (1, 0, "stylecraft"), (1, 1, "x")]
    known = rows("term string, synonym string", ("style", "style craft"))
    assert pairs(expand_synonyms(text, known, split_multiword=True)) == [
        (1, 0, "style"), (1, 1, "craft"), (1, 1, "x")]


def test_synonyms_too_many_to_broadcast(spark, docs, index, no_broadcast):
    large = I.index_of(docs, synonyms=I.default_synonyms(spark))
    assert pairs(large.postings) == pairs(index.postings)
    assert pairs(large.lengths) == pairs(index.lengths)


def test_keyword_field(docs):
    cfg = IndexConfig()
    brands = D.doc_freq(D.build_postings(D.occurrences(docs, cfg, field="Brand")))
    assert pairs(brands) == [("Atlantic", 4), ("Mid-America", 4), ("StyleCraft", 10)]
    with pytest.raises(ValueError):
        D.occurrences(docs, cfg, field="brand")


def test_chain_order(rows):
    text = rows("doc_id long, title string", (1, "The Été it"))
    plain = analyze(text, "title", Chain(folded=True, stop_words=("the",)))
    assert pairs(plain) == [(1, 1, "ete"), (1, 2, "it")]
    assert pairs(analyze(text, "title", Chain(tokenized=False))) == [(1, 0, "The Été it")]


def test_vocabulary(index):
    found = defaultdict(list)
    for field, value in pairs(index.vocabulary):
        found[field].append(value)
    assert found == {
        "Brand": ["Atlantic", "Mid-America", "StyleCraft"], "Material": ["Composite", "Hybrid", "Vinyl", "Wood"],
        "Mounting": ["Decorative", "Operable"], "Style": ["Bahama", "Board and Batten", "Louver", "Raised Panel"]}


def test_build_and_open(spark, docs, index, tmp_path, rows):
    path = str(tmp_path / "index")
    known = I.default_synonyms(spark)
    metrics = I.build_index(spark, docs, path, synonyms=known)
    assert metrics["n_docs"] == 18 and metrics["seconds"] > 0 and metrics["started"] < metrics["ended"]
    built = I.open_index(spark, path)
    for name in ("docs", "postings", "lengths", "frequencies", "suggestions", "vocabulary", "totals"):
        assert pairs(getattr(built, name)) == pairs(getattr(index, name)), name
    asked = rows("query_id long, phrase string", (1, "custom wood"))
    assert pairs(browse(built, asked).hits) == pairs(browse(index, asked).hits)

    I.build_index(spark, docs.where("doc_id < 4"), path, synonyms=known)
    assert I.open_index(spark, path).docs.count() == 4
    I.build_index(spark, docs, path, suggest_field="Brand")
    assert ("mid", "Mid-America", 4) in pairs(I.open_suggestions(spark, path))


def test_postings_of_a_build_are_sorted_once(rows):
    met = rows("doc_id long, pos int, term string", (1, 4, "b"), (1, 0, "b"), (2, 1, "a"), (1, 4, "b"), (None, 2, "b"), (None, 1, "b"), (1, 3, "a"))
    found = D.ranged_postings(met)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan
    assert sorted(map(str, found.collect())) == sorted(map(str, D.build_postings(met).collect()))
    assert [r.positions for r in found.where("term = 'b' AND doc_id = 1").collect()] == [[0, 4, 4]]


def test_kept_words_are_not_looked_for_again(spark, docs, index):
    known = I.default_synonyms(spark)
    kept = I.index_of(docs, synonyms=known, keep=True)
    for name in ("postings", "lengths", "frequencies"):
        table = getattr(kept, name)
        assert "regexp_extract_all" not in table._jdf.queryExecution().optimizedPlan().toString(), name
        assert pairs(table) == pairs(getattr(index, name)), name


ODD = [(1, "über uns the cold widget", "a"), (2, "Über über zebra ähre", "b"), (3, "東京 cold-widget Ω ωmega", "a"), (4, None, None),
       (4, "repeated id zebra", "b"), (None, "no id at all", "a"), (5, "", "b"), (6, "a1 b2 zz zebra 3.14", None)]
ODD_CONFIG = IndexConfig(facets=("kind",))


def test_build_in_many_ranges(spark, rows, tmp_path, monkeypatch):
    """One range of terms after the other gives the tables of one range; every file is sorted."""
    source = rows("doc_id long, title string, kind string", *ODD)
    tables, ranges = {}, []
    for least in (1, 4_000_000):
        monkeypatch.setattr(I, "key_ranges", lambda *args, least=least: ranges.append(key_ranges(*args, most=3, least_rows=least)) or ranges[-1])
        path = str(tmp_path / f"index-{least}")
        I.build_index(spark, source, path, ODD_CONFIG, files=4)
        I.build_blocks(spark, path, ODD_CONFIG, files=4)
        build, names = I.current_build(spark, path), ("postings", "grams", "suggestions", "best", "bounds")
        tables[least] = {name: store.open_table(spark, f"{build}/{name}") for name in names}
    assert [len(r) for r in ranges[:5]] == [3] * 5 and [len(r) for r in ranges[5:]] == [1] * 5
    for name, (table, by) in {"postings": ("term", ["term", "doc_id"]), "grams": ("term", ["piece", "at", "term"]), "bounds": ("term", ["term", "block"]),
                              "suggestions": ("word", ["gram", "doc_freq", "word"]), "best": ("word", ["order", "gram", "rank"])}.items():
        many, one = (sorted(map(str, tables[least][name].collect())) for least in (1, 4_000_000))
        assert many == one and many, name
        in_files = tables[1][name].select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"), F.struct(*by).alias("key"))
        for r in in_files.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("found")).collect():
            keys = [tuple((v is not None, v.encode() if isinstance(v, str) else v) for v in x.key) for x in r.found]
            assert keys == sorted(keys), name


def test_key_ranges_meet_every_value_once(rows):
    values = [(x,) for x in ("", "a", "ab", "abc", "aé", "z", "é", "éa", "ω", "東", "東京", "\U0001f600", "\uffee", None)]
    table = rows("v string", *values)
    for least in (1, 3, 100):
        parts = key_ranges(table, "v", least_rows=least)
        assert len(parts) == max(1, min(8, 13 // least))
        found = [x for part in parts for x in pairs(table.where(part).fillna("-"))]
        assert sorted(found) == sorted((v or ("-" if v is None else ""),) for (v,) in values)


def test_written_tables_leave_no_shuffle_files(spark, index, tmp_path):
    def shuffled():
        kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for name in (kept.apply(i).name() for i in range(kept.size())) if name.startswith("shuffle")}

    before, held = shuffled(), index.postings.select("term", "doc_id", "tf")
    store.write_table(held, str(tmp_path / "postings"), sort_by=["term", "doc_id"], files=3)
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert pairs(held) == pairs(store.open_table(spark, str(tmp_path / "postings")))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_readers_keep_their_build(spark, docs, tmp_path, rows):
    path, asked = str(tmp_path / "index"), rows("query_id long, phrase string", (1, "custom wood"))
    with pytest.raises(FileNotFoundError):
        I.open_index(spark, path)
    I.build_index(spark, docs, path)
    first, reader = I.current_build(spark, path), I.open_index(spark, path)
    before = pairs(browse(reader, asked).hits)
    I.build_index(spark, docs.where("doc_id < 4"), path)
    assert pairs(browse(reader, asked).hits) == before and len(before) == 6
    assert I.open_index(spark, path).docs.count() == 4

    def fail(*_args, **_kw):
        raise RuntimeError("lost")

    with pytest.MonkeyPatch.context() as patch:  # a build that breaks off is never opened
        patch.setattr(I.D, "facet_vocabulary", fail)
        with pytest.raises(RuntimeError):
            I.build_index(spark, docs, path)
    assert I.open_index(spark, path).docs.count() == 4
    I.drop_old_builds(spark, path)
    assert I.current_build(spark, path) != first and I.open_index(spark, path).docs.count() == 4
    with pytest.raises(AnalysisException):
        spark.read.parquet(f"{first}/docs")


def test_postings_files_cover_ranges(spark, docs, tmp_path):
    path = str(tmp_path / "ranged")
    store.write_table(D.build_postings(D.occurrences(docs)), path, sort_by=["term", "doc_id"], files=3)
    files = (store.open_table(spark, path).groupBy(F.input_file_name().alias("f"))
             .agg(F.min(F.struct("term", "doc_id")).alias("low"), F.max(F.struct("term", "doc_id")).alias("high")).collect())
    ordered = sorted((tuple(r.low), tuple(r.high)) for r in files)
    assert len(ordered) == 3 and all(a[1] < b[0] for a, b in zip(ordered, ordered[1:]))


def test_absent_table(spark, tmp_path):
    empty = I.open_suggestions(spark, str(tmp_path / "none"))
    assert empty.columns == ["gram", "word", "doc_freq"] and empty.count() == 0


def test_workspace_needs_a_shared_folder(spark, monkeypatch):
    assert store.workspace(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    monkeypatch.setattr(type(spark.conf), "get", lambda *a: None)
    monkeypatch.setattr(type(spark.sparkContext), "master", property(lambda self: "yarn"), raising=False)
    with pytest.raises(RuntimeError):
        store.workspace(spark, "x")


# --- XML -----------------------------------------------------------------------------


def product_xml(title, material="Vinyl", style="Louver", mounting="Operable", brand="Atlantic"):
    inner = "".join(f"<{n}>{v}</{n}>" for n, v in (
        ("material", material), ("style", style), ("mounting", mounting), ("brand", brand)) if v is not None)
    return f"\t<product>\n\t\t<title>{title}</title>\n\t\t<properties>{inner}</properties>\n\t</product>\n"


def write_xml(path, *records):
    path.write_text('<?xml version="1.0" encoding="utf-8" ?>\n<products>\n' + "".join(records) + "</products>\n")
    return str(path)


def test_xml_products(spark, tmp_path, docs):
    path = write_xml(tmp_path / "p.xml", *[product_xml(*row[1:]) for row in PRODUCT_ROWS])
    fields = xml_records.extract_fields(xml_records.read_record_texts(spark, path))
    assert pairs(assign_ids(fields)) == PRODUCT_ROWS
    bound = xml_records.read_products(spark, path).select("title", "properties.*")
    assert pairs(bound) == sorted(row[1:] for row in PRODUCT_ROWS)


def test_xml_odd_records(spark, tmp_path):
    path = write_xml(
        tmp_path / "p.xml",
        product_xml("Nuts &amp; Bolts"),
        product_xml("twice").replace("</material>", "</material><material>Wood</material>"),
        product_xml("deep").replace("<material>Vinyl</material>", "<more><material>Pine</material></more>"),
        product_xml("marked").replace("<product>", '<product id="7">'),
        product_xml("empty", brand=""),
    )
    found = {r.title: (r.Material, r.Brand) for r in
             xml_records.extract_fields(xml_records.read_record_texts(spark, path)).collect()}
    assert found == {"Nuts & Bolts": ("Vinyl", "Atlantic"), "twice": ("Vinyl", "Atlantic"), "deep": ("Pine", "Atlantic"),
                     "marked": ("Vinyl", "Atlantic"), "empty": ("Vinyl", "")}


def hidden(text):
    return "<![CDATA[" + text + "]]>"


# Titles by the record that has them; every one is cut falsely at least once, but for the plain ones.
SECTIONED = [
    ("a </product> b", product_xml(hidden("a </product> b"))),
    ("plain", product_xml("plain")),
    ("old", "<!-- " + product_xml("gone") + product_xml("gone too") + " -->" + product_xml("old")),
    ("x<!-- </product> y", product_xml(hidden("x<!-- </product> y"))),
    ("instructed", "<?keep </product> ?>" + product_xml("instructed")),
    ("many" + "</product>" * 40, product_xml(hidden("many" + "</product>" * 40))),
    ("twofold </product>", product_xml(hidden("twofold </product>")).replace("</properties>", "<!-- ]]> </product> <![CDATA[ --></properties>")),
    ("last", "<!-- <product> -->" + product_xml("last") + "<!-- </product> </product> -->"),
]


@pytest.mark.parametrize("split_bytes", [120, 700, 128 << 20])
def test_xml_closing_tags_in_sections(spark, tmp_path, split_bytes):
    """Splits smaller than a record, so sections reach over several of them, and two files that must not mix."""
    write_xml(tmp_path / "a.xml", *[record for _, record in SECTIONED * 3])
    write_xml(tmp_path / "b.xml", *[record for _, record in reversed(SECTIONED)])
    write_xml(tmp_path / "c.xml", product_xml("clean"))
    write_xml(tmp_path / "d.xml")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        found = xml_records.extract_fields(xml_records.read_record_texts(spark, str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.title for r in found) == sorted(["clean"] + [title for title, _ in SECTIONED] * 4)
    assert {(r.Material, r.Style, r.Mounting, r.Brand) for r in found} == {("Vinyl", "Louver", "Operable", "Atlantic")}


def test_xml_without_records(spark, tmp_path):
    path = write_xml(tmp_path / "none.xml", "<!-- ", product_xml("gone"), "-->")
    assert xml_records.read_record_texts(spark, path).collect() == []


def test_xml_missing_field(spark, tmp_path):
    path = write_xml(tmp_path / "p.xml", product_xml("good"), product_xml("bad", brand=None))
    records = xml_records.read_record_texts(spark, path)
    with pytest.raises(Exception, match="record without Brand"):
        xml_records.extract_fields(records).collect()
    kept = {r.title: r.missing for r in xml_records.extract_fields(records, on_missing="quarantine").collect()}
    assert kept == {"good": [], "bad": ["Brand"]}


def test_projection_needs_every_column(docs):
    with pytest.raises(ValueError, match="Brand"):
        to_documents(docs, {c: c for c in docs.columns if c != "Brand"})

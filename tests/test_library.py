"""Catalogue, filters, dedup, state, chat, ETL, sources and streaming on small cases with known answers."""

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.operators import catalogue, chat, dedup, etl, evaluation, facets, filters, models, state
from lodestack.sources import files, transfer, web
from lodestack.streaming import ingest


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first().r


def test_text_rules(spark):
    assert one(spark, " HTTPS://Example.COM:443/policy?q=1#part ", X.canonical_url) == "https://example.com/policy?q=1"
    assert one(spark, "http://Example.com.:8080", X.canonical_url) == "http://example.com:8080"
    for bad in ("file:///tmp/a", "https://u:p@example.com/", "https://example.com:bad/", "https://example.com:70000/", "x", ""):
        assert one(spark, bad, X.canonical_url) is None
    assert one(spark, "100%_complete!", X.like_pattern) == "%100!%!_complete!!%"
    assert one(spark, "A  b\n C ", X.normalised_hash) == one(spark, "a B c", X.normalised_hash)
    assert one(spark, "sk-1234567890", X.masked_secret) == "sk-1…7890"
    assert one(spark, "..\\up/a.PDF", X.safe_filename) == "a.PDF" and one(spark, "a.exe", X.safe_filename) is None
    assert one(spark, "Was? Nein! 法", X.question_key) == "wasnein法"
    toc = "Contents\n" + "\n".join(f"{i} Part .... {i}" for i in range(5))
    assert one(spark, toc, X.is_contents_page) and not one(spark, "Contents of a box", X.is_contents_page)


def test_filter_inference(spark):
    labels = spark.createDataFrame([("policy_areas", "Climate Adaptation"), ("country_regions", "Australia"), ("country_regions", "China"), ("source_organisations", "EU")], "dimension string, value string")
    cases = {
        0: "Use Australia Climate Adaptation documents published in 2018 in English.",
        1: "I want updates after 2026; filter the files which published before 2026.",
        2: "Only use documents published after 2023.",
        3: "请用中文回答：比较这些英文和法文政策。",
        4: "中国和澳大利亚 latest",
    }
    q = spark.createDataFrame(list(cases.items()), "query_id long, question string")
    r = {x.query_id: x for x in filters.infer(q, labels, 2024).collect()}
    assert (r[0].policy_areas, r[0].country_regions, r[0].languages, r[0].year_from, r[0].year_to) == (["Climate Adaptation"], ["Australia"], ["English"], 2018, 2018)
    assert (r[1].year_from, r[1].year_to) == (None, 2025)
    assert (r[2].year_from, r[2].year_to) == (2024, None)
    assert r[3].languages == []
    assert r[4].country_regions == ["Australia", "China"] and r[4].freshness and r[4].year_from == 2019


def test_filter_fallback_and_hits(spark):
    docs = spark.createDataFrame([(1, ["A"], "X", "o", "en", ["t", "u"], 2018), (2, ["b"], "Y", "o", "fr", [], None)], "doc_id long, policy_areas array<string>, country_region string, source_organisation string, language string, keywords array<string>, year int")
    schema = "query_id long, policy_areas array<string>, country_regions array<string>, source_organisations array<string>, languages array<string>, tags array<string>, year_from int, year_to int, freshness boolean"
    f = spark.createDataFrame([(0, [], [], [], [], [], 2022, None, True), (1, ["a", "z"], [], [], ["EN"], ["T", "u"], 2018, 2018, False), (2, [], [], [], [], [], None, None, False), (3, [], [], [], [], ["t", "x"], None, None, False)], schema)
    r = {x.query_id: x for x in filters.match_counts(f, docs).collect()}
    assert r[0].fallback and "older sources" in r[0].notice and r[1].n_matched == 1 and not r[1].fallback
    assert not r[2].applied and r[2].description == "none" and r[3].fallback
    assert {(x.query_id, x.doc_id) for x in facets.hits(f, facets.FacetIndex(docs)).collect()} == {(1, 1)}


def test_search_and_match_fields(spark):
    docs = spark.createDataFrame([(1, "A 100% plan", "a.pdf", None, "report", "Org", "X", ["Health", "Law"], ["k"], 2018), (2, None, "b.pdf", None, "web", "Org", "Y", [], [], None)], "doc_id long, title string, original_filename string, summary string, source_type string, source_organisation string, country_region string, policy_areas array<string>, keywords array<string>, year int")
    assert [r.doc_id for r in catalogue.search(docs, "100%").collect()] == [1]
    assert [r.doc_id for r in catalogue.search(docs, "health law").collect()] == [1]
    assert catalogue.search(docs, "  ").count() == 2
    assert docs.select(catalogue.match_fields("health', 'law").alias("m")).first().m == ["policy_areas"]
    with pytest.raises(ValueError):
        catalogue.page_of(docs, page=0)


def test_resolve_fails_on_a_miss(spark):
    docs = spark.createDataFrame([(1, "a.pdf", datetime(2024, 1, 1)), (2, "a.pdf", datetime(2024, 1, 2))], "doc_id long, original_filename string, uploaded_at timestamp")
    assert catalogue.resolve(spark.createDataFrame([("a.pdf",), ("1",)], "identifier string"), docs).orderBy("identifier").collect() == [("1", 1), ("a.pdf", 2)]
    with pytest.raises(Exception, match="unknown document"):
        catalogue.resolve(spark.createDataFrame([("nope",)], "identifier string"), docs).collect()


def test_dedup_rules(spark):
    docs = spark.createDataFrame([(1, "k", 2, datetime(2024, 1, 2)), (2, "k", 5, datetime(2024, 1, 3)), (3, "k", 5, datetime(2024, 1, 1)), (4, "z", 1, datetime(2024, 1, 1))], "doc_id long, key string, chunks int, uploaded_at timestamp")
    assert {(r.doc_id, r.action) for r in dedup.keep_report(docs, "key", "chunks").collect()} == {(1, "remove"), (2, "remove"), (3, "keep")}
    text = spark.createDataFrame([(1, "abcdefghij" * 120), (2, "short"), (3, "".join(chr(97 + i % 26) + str(i) for i in range(1200)))], "doc_id long, text string")
    sizes = {(r.doc_id, r.window): len(r.text) for r in dedup.semantic_windows(text).collect()}
    assert set(k[0] for k in sizes) == {1, 3} and sizes[1, 0] == 600 and len({v for k, v in sizes.items() if k[0] == 3}) == 1
    windows = spark.createDataFrame([(1, w, [1.0, w * 0.01]) for w in range(3)] + [(2, 0, [0.0, 1.0]), (2, 1, [1.0, 0.0])], "doc_id long, window long, vector array<double>")
    corpus = spark.createDataFrame([(10, 7, [1.0, 0.0]), (11, 7, [1.0, 0.02]), (12, 1, [1.0, 0.0])], "doc_id long, owner long, vector array<double>")
    assert [(r.doc_id, r.duplicate_of) for r in dedup.semantic_duplicates(windows, corpus).collect()] == [(1, 7)]


def test_candidates_drop_repeats(spark):
    c = spark.createDataFrame([(0, 0, "What is it?"), (0, 1, "what IS it"), (0, 2, "Asked before"), (0, 3, "  "), (0, 4, "New one")], "group_id long, position int, text string")
    h = spark.createDataFrame([(0, "asked, before!")], "group_id long, text string")
    o = spark.createDataFrame([(0, "Original")], "group_id long, text string")
    assert [r.text for r in dedup.clean_candidates(c, h, o).orderBy("kept").collect()] == ["What is it?", "New one"]


def test_chat_rules(spark):
    pages = spark.createDataFrame([(0, k // 30, k, f"https://{k}.example", f"Page {k}") for k in range(60)] + [(0, 0, 99, "https://0.example", "Page 0")], "session_id long, turn int, position int, url string, title string")
    kept = chat.pages_seen(pages).orderBy("position").collect()
    assert len(kept) == 50 and kept[-1].url == "https://59.example"
    asked = spark.createDataFrame([(1, 0, 1, "second"), (2, 0, None, "page 1"), (3, 0, None, "page"), (4, 0, 0, "none")], "ask_id long, session_id long, turn_hint int, hint string")
    got = {r.ask_id: (r.url, r.n_candidates) for r in chat.resolve_reference(pages, asked).collect()}
    assert got[1] == ("https://31.example", 1) and got[2] == ("https://1.example", 1) and got[3][0] is None and got[4] == (None, 0)
    cites = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "a"), (0, 4, "c")], "session_id long, position int, key string")
    assert [r.number for r in chat.numbered_citations(cites).orderBy("position").collect()] == [1, 2, 1, 3]
    m = spark.createDataFrame([(0, 0, "user", 1, 1), (0, 1, "assistant", 5, 5), (0, 2, "user", 1, 1), (0, 3, "assistant", 2, None), (0, 4, "assistant", 3, 4)], "session_id long, seq int, role string, input_tokens int, output_tokens int")
    assert [tuple(r) for r in chat.token_usage(m).collect()] == [(0, 5, 4, 9)]


def test_state_rules(spark):
    old = spark.createDataFrame([(1, "kept", ["x"], "j", datetime(2024, 1, 1)), (2, None, [], "j", datetime(2024, 1, 1)), (3, "gone", ["x"], "j", None)], "doc_id long, title string, keywords array<string>, metadata_json string, reviewed_at timestamp")
    new = spark.createDataFrame([(i, "new", ["n"], "k") for i in (1, 2, 3, 4)], "doc_id long, title string, keywords array<string>, metadata_json string")
    got = {r.doc_id: (r.title, r.keywords, r.metadata_json) for r in state.merge_generated(old, new, "doc_id").collect()}
    assert got == {1: ("kept", ["x"], "k"), 2: ("new", ["n"], "k"), 3: ("new", ["n"], "k"), 4: ("new", ["n"], "k")}


@pytest.mark.parametrize(("words_per", "n"), [(1, 1), (2, 2)])
def test_chunk_budgets(words_per, n):
    found = etl.Chunker(480, 0, lambda t: words_per * len(t.split())).chunks([(1, "policy " * 250)])
    assert len(found) == n and all(c[4] <= 480 for c in found)


def test_chunk_budget_is_clamped():
    assert [etl.Chunker(b, 10**6).budget for b in (1, 64, 8000, 100_000)] == [64, 64, 8000, 8000]
    assert etl.Chunker(100, 10**6).overlap == 50 and etl.Chunker(100, -3).overlap == 0


@pytest.mark.parametrize("budget, overlap", [(64, 0), (64, 32), (128, 16), (480, 60)])
def test_chunk_rules_hold_for_every_document(spark, budget, overlap):
    """Within the budget, all words in order, each chunk headed by an end of the one before, and none shorter than it must be."""
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").collect():
        pages = [(k, part) for k, part in enumerate(row.text.replace("\n", "\n\n").split("\n\n\n\n"))]
        words = " ".join(part for _, part in pages).split()
        # where a chunk may end among the words: repeated words leave several places open
        found, ends, before = etl.Chunker(budget, overlap).chunks(pages), {0}, []
        for index, (number, first, last, text, tokens) in enumerate(found):
            own, piece, after = text.split(), text.split("\n\n"), set()
            assert number == index and tokens == len(own) <= budget and first <= last
            for at in ends:
                for head in range(min(overlap, at) + 1):
                    if words[at - head : at - head + len(own)] != own or own[:head] != before[len(before) - head :]:
                        continue
                    new = next((p for k, p in enumerate(piece) if sum(len(x.split()) for x in piece[: k + 1]) > head), "")
                    if not index or len(before) + len(new.split()) > budget:
                        after.add(at - head + len(own))
            ends, before = after, own
        assert not words and not found or len(words) in ends


def test_chunks_cover_and_overlap(spark):
    text = "\n\n".join(f"Paragraph {i}. " + " ".join(f"w{i}x{j}" for j in range(20)) + "." for i in range(30)) + "\n\n" + "long" * 2000
    chunker = etl.Chunker(100, 25)
    found = chunker.chunks([(1, text), (2, "tail"), (3, None)])
    assert [c[0] for c in found] == list(range(len(found))) and found[-1][2] == 2
    assert {w.strip(".") for c in found for w in c[3].split()} >= {f"w{i}x{j}" for i in range(30) for j in range(20)}
    assert all(c[4] <= 100 for c in found)
    for a, b in zip(found, found[1:]):
        # what opens a chunk closed the one before it
        assert a[3].endswith(b[3].split("\n\n")[0])
    assert etl.Chunker(100, 25).chunks([]) == []
    docs = spark.createDataFrame([(1, [(1, text)]), (2, None)], "doc_id long, pages array<struct<page:int,text:string>>")
    assert etl.chunk(docs, 100, 25).count() == len(etl.Chunker(100, 25).chunks([(1, text)]))


def test_clean_pages(spark):
    body = lambda k: f"Header 2024\nBody {chr(97 + k) * 3} here " + "text " * 5 + ("\nReferences\n[1] a" if k == 8 else "") + f"\nPage {k}"
    rows = [(1, k, body(k)) for k in range(10)] + [(2, 0, "Contents\n" + "\n".join(f"a .... {i}" for i in range(4)))]
    got = {(r.doc_id, r.page): r.text for r in etl.clean_pages(spark.createDataFrame(rows, "doc_id long, page int, text string")).collect()}
    assert got[1, 3].startswith("Body ddd") and "Header" not in got[1, 3] and "Page" not in got[1, 3]
    assert got[1, 8].startswith("Body iii") and "[1]" not in got[1, 8] and got[1, 9] == "" and got[2, 0] == ""


def test_model_answers(spark):
    assert one(spark, '["a", "b \\"c\\"", "cut', etl.recovered_strings) == ["a", 'b "c"']
    assert one(spark, "a;b, c", etl.string_to_list) == ["a", "b, c"]


def test_models_as_columns(spark):
    df = spark.createDataFrame([("ab",), (None,), ("abc",)], "t string")
    got = df.select(models.embed(F.col("t"), lambda: lambda texts: [[len(t), 1] for t in texts]).alias("v"), models.counted(F.col("t"), lambda: lambda texts: [len(t) for t in texts]).alias("n"), models.rerank_score(F.col("t"), F.lit("q"), lambda: lambda q, t: [None] * len(q)).alias("s")).collect()
    assert [(r.v, r.n, r.s) for r in got] == [([2.0, 1.0], 2, 0.0), (None, 1, 0.0), ([3.0, 1.0], 3, 0.0)]
    assert models.vector_table("BAAI/bge small", 384) == "chunk_vectors_baai_bge_small_384"


def test_measures(spark):
    ranks = spark.createDataFrame([(0, 1, True), (0, 2, False), (1, 1, False), (1, 2, True), (2, 1, False)], "case_id long, rank int, relevant boolean")
    r = evaluation.recall_and_mrr(ranks).first()
    assert (r.cases, r.recall_1, r.recall_3, r.mrr) == (3, 0.333333, 0.666667, 0.5)
    c = spark.createDataFrame([(0.1, True), (0.5, True), (0.6, False)], "value double, expected boolean")
    assert evaluation.calibration(c, 0.45).first().midpoint == pytest.approx(0.55)


def test_files(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.txt").write_bytes(b" caf\xc3\xa9 \xff ")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "d.exe").write_bytes(b"x")
    found = files.discover(spark, str(tmp_path))
    assert {(r.filename, r.valid) for r in found.collect()} == {("a.docx", True), ("b.txt", False), ("c.pdf", True)}
    pages = {r.path.rsplit("/", 1)[1]: r for r in files.extract(found).collect()}
    assert pages["a.docx"].pages[0].text == "Hello\na | b" and pages["b.txt"].pages[0].text == "café �" and pages["c.pdf"].error == "unsupported type"
    read = files.extract(found, {".pdf": lambda c: [{"page": 1, "text": ""}]}, ocr=lambda c, p: f"page {p} read")
    assert {r.path.rsplit("/", 1)[1]: r for r in read.collect()}["c.pdf"].pages[0].text == "page 1 read"


class Fixed(web.Provider):
    def search(self, query, limit):
        return [{"url": f"https://{query}/{k}", "title": query} for k in range(9)]


def test_web_search_source(spark):
    web.PROVIDERS["fixed"] = Fixed
    with pytest.raises(NotImplementedError):
        web.provider("unavailable").search("x", 1)
    with pytest.raises(ValueError):
        web.provider("other")
    rows = list(web.WebSearchReader({"provider": "fixed", "queries": "a\nb", "limit": "2"}).read(web.Query("a")))
    assert [r[1] for r in rows] == ["https://a/0", "https://a/1"]
    spark.dataSource.register(web.WebSearch)


def test_catalogue_transfer(spark, tmp_path):
    now = spark.createDataFrame([("p", "m1", "old", "s1"), ("p", "m2", "old", "s2")], "provider string, model string, label string, api_key string")
    path = str(tmp_path / "c")
    transfer.export_rows(now.where("model = 'm1'").withColumn("label", F.lit("new")), path)
    got = {(r.model, r.label, r.api_key) for r in transfer.import_rows(spark, path, now, ["provider", "model"]).collect()}
    assert got == {("m1", "new", "s1"), ("m2", "old", "s2")}
    spark.createDataFrame([("other", 1)], "format string, version int").write.json(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="not a catalogue"):
        transfer.import_rows(spark, str(tmp_path / "bad"), now, ["provider", "model"]).collect()


def test_ingest_stream(spark, tmp_path):
    src, lib, ck = (str(tmp_path / n) for n in ("in", "lib", "ck"))
    schema = "doc_id long, text string"
    spark.createDataFrame([(2, "A b"), (1, "a  B"), (3, "c")], schema).coalesce(1).write.parquet(src)
    ingest.ingest(ingest.arrivals(spark, src, schema), lib, ck).awaitTermination()
    assert {r.doc_id for r in spark.read.parquet(lib).collect()} == {1, 3}
    spark.createDataFrame([(4, "C"), (5, "d")], schema).coalesce(1).write.mode("append").parquet(src)
    ingest.ingest(ingest.arrivals(spark, src, schema), lib, ck).awaitTermination()
    assert {r.doc_id for r in spark.read.parquet(lib).collect()} == {1, 3, 5}
    # hashes of other prefixes aren't opened, and no library is no error
    known = ingest.known_hashes(spark, lib, ["00", "ff"], -1)
    assert "prefix#" in known._jdf.queryExecution().optimizedPlan().toString() and ingest.known_hashes(spark, str(tmp_path / "none"), ["00"], 0) is None
    own = spark.read.parquet(lib).where("doc_id = 3").first()
    assert [r.content_hash for r in ingest.known_hashes(spark, lib, [own.content_hash[:2]], -1).where(F.col("content_hash") == own.content_hash).collect()] == [own.content_hash]
    assert ingest.known_hashes(spark, lib, [own.content_hash[:2]], own.batch).where(F.col("content_hash") == own.content_hash).count() == 0

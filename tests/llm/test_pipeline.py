"""The pipeline against plain code over the small table; language ID is held against its own verdicts."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql.types import StructType
from test_dedup_mixing import brute_components, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from lodestack.llm import langid, mixing

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_code(spark):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    rows = {}
    for r in docs.collect():
        lang, _, _, _, background = langid.infer(r.text, model)
        if lang != "und" and background <= langid.Settings().max_background:
            rows[r.doc_id] = r
    last = {}
    for i, r in rows.items():
        last[r.text] = max(i, last.get(r.text, -1))
    rows = {i: rows[i] for i in last.values()}
    parts = brute_components({i: plain_fingerprint(r.text) for i, r in rows.items()})
    rows = {i: r for i, r in rows.items() if parts[i] == i}
    by_source = defaultdict(list)
    for i, r in rows.items():
        by_source[r.source].append((hashlib.md5(str(i).encode()).hexdigest(), i, len((r.text or "").split())))
    total = sum(n for s in by_source.values() for _, _, n in s)
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(by_source))}
    size = {s: sum(n for _, _, n in by_source[s]) for s in weight}
    target, free = {}, set(weight)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for s, items in by_source.items():
        start = 0
        for _, i, n in sorted(items):
            taken = sum(max(0, min(n, round(target[s]) - start - e * size[s])) for e in range(3))
            start += n
            if n and (copies := int(taken / n + 0.5)):
                ids = tok.encode(rows[i].text, add_special_tokens=False).ids
                want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(rows[i].text.encode()).hexdigest()] += copies
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns


def test_mixed_documents_stand_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {r.doc_id: r.positions for r in mixing.mix(docs).collect()}
    seen, last = Counter(), 0.0
    for r in mixing.mixed_documents(docs).select("doc_id").collect():
        at = plan[r.doc_id][seen[r.doc_id]]
        seen[r.doc_id] += 1
        assert at >= last
        last = at


def test_odd_rows_through_every_stage(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    text = base.where("lang = 'en' and n_chars > 400").orderBy("doc_id").first().text
    # the words backwards, so that no document of the table has its shingles
    long = (" ".join(reversed(text.split())) + " ") * 600
    schema = StructType([*base.schema.fields]).add("digest", "string").add("fp", "long").add("size", "long").add("position", "double").add("__id", "long").add("ids_sha256", "string")
    clash = ("clash", 1, 2, 0.5, 3, "clash")
    odd = [
        (9_000_001, None, "en", "web", 0), (9_000_002, "", None, "web", 0), (9_000_003, " \t\n", "en", None, 3), (9_000_004, "12 34 +-", "de", None, 8),
        (9_000_005, text + " zero", None, None, None), (9_000_005, text + " zero", None, None, None), (None, text + " none", "en", "web", 1), (None, text + " none", None, "web", 1),
        (9_000_006, long, "en", "web", None), (9_000_007, long, "en", "web", None), (9_000_008, text[:300], "en", "src", 1), (9_000_008, text[200:700], "en", "src", 1),
    ]
    rows = [(*r, *clash) for r in odd] + [(*(r[c] for c in base.columns), *clash) for r in base.limit(150).collect()]
    order = {c: k for k, c in enumerate(base.columns)}
    keys = ("doc_id", "text", "lang", "source", "n_chars")
    assert set(order) == set(keys)
    rows = [(*(dict(zip(keys, r[:5], strict=True))[c] for c in base.columns), *r[5:]) for r in rows[: len(odd)]] + rows[len(odd) :]
    docs = spark.createDataFrame(rows, schema)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.keep(stage(spark, docs, SF), "odd")
        if name != "BPE":
            assert out.columns == docs.columns and {r.digest for r in out.select("digest").collect()} <= {"clash"}
        seen[name], docs = out, out
    ids = {n: Counter(r.doc_id for r in d.select("doc_id").collect()) for n, d in seen.items()}
    gone = {9_000_001, 9_000_002, 9_000_003, 9_000_004}
    assert not gone & set(ids["language ID"]) and ids["language ID"][9_000_005] == 2 and ids["language ID"][None] == 2
    assert ids["exact dedup"][9_000_005] == 1 and ids["exact dedup"][None] == 1 and 9_000_006 not in ids["exact dedup"] and ids["exact dedup"][9_000_007] == 1
    # one id with two texts: both live on, through every stage
    assert all(ids[name][9_000_008] == 2 for name in ("language ID", "exact dedup", "SimHash near-dedup"))
    assert ids["SimHash near-dedup"][None] == 1 and ids["SimHash near-dedup"][9_000_007] == 1
    assert ids["mixing"] == ids["BPE"]
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and (name == "BPE" or out.columns == empty.columns)

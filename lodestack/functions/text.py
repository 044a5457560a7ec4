"""Text expressions: tokenizers, hashes, URL and filename rules, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the keyword tokenizer: scripts cut into character pairs, and glue words.
CJK_RUN = r"[぀-ヿ㐀-䶿一-鿿豈-﫿]+"
KEYWORD_STOPS = "a an and are as at be but by for from has have in into is it its of on or that the their this to was were which will with".split()
# Fixed values of the evidence gate's tokenizer.
EVIDENCE_STOPS = "a an and are as at be by do does for from how in is it may of on one or the this to what when which who".split()
GENERIC_INSTRUMENT_TERMS = "act ai bill framework plan policy regulation regulations s standard".split()
NAMED_INSTRUMENT = r"\b((?:(?:[A-Z][A-Za-z0-9'’.-]*|\d{4})\s+){1,7}(?:Act|Bill|Regulations?|Standard|Framework|Policy|Plan))\b"


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def keyword_tokens(text: Column) -> Column:
    """Pairs of CJK characters (a run of one alone), then lower-case word runs without glue words, in order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = lambda t: F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: ~w.isin([*KEYWORD_STOPS, ""]))
    runs = F.regexp_extract_all(low, F.lit(f"({CJK_RUN})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    # most texts have no such character: those of single bytes, and those with none between the first and the last, need no search for runs
    wide = (F.octet_length(low) > F.length(low)) & low.rlike(f"[{CJK_RUN[1]}-{CJK_RUN[-3]}]")
    return F.when(wide & low.rlike(CJK_RUN), F.concat(pairs, words(F.regexp_replace(low, CJK_RUN, " ")))).otherwise(words(low))


def ascii_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))


def question_terms(question: Column) -> Column:
    return F.array_except(ascii_terms(question), literals(EVIDENCE_STOPS))


def lexical_matches(question: Column, text: Column) -> Column:
    return F.size(F.array_intersect(question_terms(question), ascii_terms(text)))


def lexical_coverage(question: Column, text: Column) -> Column:
    return F.coalesce(F.try_divide(lexical_matches(question, text).cast("double"), F.size(question_terms(question)).cast("double")), F.lit(0.0))


def unsupported_instrument(question: Column, evidence: Column) -> Column:
    """The first named instrument of the question with a distinctive term that the evidence lacks; null if all are supported."""
    names = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(NAMED_INSTRUMENT), F.lit(1))
    generic = literals(GENERIC_INSTRUMENT_TERMS)
    return F.get(F.filter(names, lambda n: F.size(F.array_except(F.array_except(ascii_terms(n), generic), ascii_terms(evidence))) > 0), F.lit(0))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalised_hash(text: Column) -> Column:
    """SHA-256 of the text with white space collapsed, in lower case."""
    return F.sha2(F.lower(collapsed(text)), 256)


def question_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9一-鿿]+", "")


URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case without default port, trailing dot or fragment; null if it isn't an acceptable web address."""
    raw = F.trim(url)
    part = lambda k: F.regexp_extract(raw, URL, k)
    scheme, authority = F.lower(part(1)), part(2)
    bracketed = authority.startswith("[")
    host = F.when(bracketed, F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\])", 1))).otherwise(F.rtrim(F.lower(F.regexp_replace(authority, r":[^:]*$", "")), F.lit(".")))
    port_text = F.regexp_extract(authority, r":([^:\]]*)$", 1)
    port = F.when(port_text.rlike("^[0-9]{1,9}$"), port_text.try_cast("int"))
    bad = ~scheme.isin("http", "https") | authority.contains("@") | (F.length(host) == 0) | (host == "[]") | ((F.length(port_text) > 0) & (port.isNull() | (port > 65535)))
    shown = F.when(port.isNull() | ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443)), F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string")))
    query = part(4)
    return F.when(~bad, F.concat(scheme, F.lit("://"), host, shown, part(3), F.when(F.length(query) > 0, F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def slug_filename(title: Column, url: Column) -> Column:
    base = F.substring(F.replace(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)[^\w\- ]+", "")), F.lit(" "), F.lit("_")), 1, 80)
    return F.concat(F.when(F.length(base) > 0, base).otherwise(F.substring(F.sha2(url, 256), 1, 16)), F.lit(".md"))


MIME = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".txt": "text/plain",
    ".md": "text/markdown",
}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def mime_type(name: Column) -> Column:
    out = None
    for ext, mime in MIME.items():
        out = F.when(extension(name) == ext, mime) if out is None else out.when(extension(name) == ext, mime)
    return out.otherwise("application/octet-stream")


def safe_filename(name: Column) -> Column:
    """The last path component; null if its type isn't supported."""
    last = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(extension(last).isin(*MIME), last)


def valid_content(name: Column, content: Column) -> Column:
    """Whether bytes look like what the name says: PDF and ZIP signatures, or UTF-8 without NUL."""
    ext, head = extension(name), F.hex(F.substring(content, 1, 4))
    plain = F.is_valid_utf8(content.cast("string")) & ~F.hex(content).rlike("^(..)*00")
    return F.when(ext == ".pdf", head == "25504446").when(ext == ".docx", head == "504B0304").when(ext.isin(".txt", ".md"), plain).otherwise(False)


def masked_secret(key: Column) -> Column:
    return F.when(key.isNull() | (key == ""), None).when(F.length(key) <= 8, F.lit("****")).otherwise(F.concat(F.substring(key, 1, 4), F.lit("…"), F.substring(key, -4, 4)))


def lossy_title(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike("[?？]{3,}")


def excerpt(text: Column, head: int = 9000, mid: int = 5000, tail: int = 2000) -> Column:
    """Head, middle and tail of a text that is longer than the three together."""
    n = F.length(text)
    start = F.greatest(F.lit(head), F.floor((n - mid) / 2).cast("int"))
    parts = F.concat_ws("\n[...]\n", F.substring(text, 1, head), F.substring(text, start + 1, F.lit(mid)), F.substring(text, n - tail + 1, F.lit(tail)))
    return F.when(n <= head + mid + tail, text).otherwise(parts)


def heuristic_language(text: Column) -> Column:
    sample = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 20000))
    has = lambda *words: F.lit(False) if not words else __import__("functools").reduce(lambda a, b: a | b, [sample.contains(w) for w in words])
    return F.when(F.trim(sample) == "", None).when(sample.rlike("[Ѐ-ӿ]"), "Bulgarian").when(has("transformaci", "polit", "digitalizaci"), "Spanish").when(has("strat", "numer", "gouvernance"), "French").otherwise("English")


def is_contents_page(text: Column) -> Column:
    leaders = F.regexp_count(text, F.lit(r"\.{3,}\s*\d+"))
    entries = F.regexp_count(text, F.lit(r"(?m)^\s*\d+(\.\d+)*\s+.+\s+\d+\s*$"))
    return F.lower(text).contains("contents") & ((leaders >= 4) | (entries >= 6))


def like_pattern(query: Column) -> Column:
    """A LIKE pattern, escaped by !, for a literal substring."""
    out = query
    for c in "!%_":
        out = F.replace(out, F.lit(c), F.lit("!" + c))
    return F.concat(F.lit("%"), out, F.lit("%"))


# English for labels of the model catalogue that are in Chinese.
ENGLISH = {
    "智谱": "Zhipu",
    "可选维度 256/512/1024/2048": "Optional dimensions: 256/512/1024/2048",
    "固定 1024 维": "Fixed at 1024 dimensions",
    "文本重排序": "Text reranking",
    "对话补全": "Chat completions",
    "对话补全（异步）": "Async chat completions",
    "图像生成": "Image generation",
    "图像生成（异步）": "Async image generation",
    "文本分词器": "Text tokenizer",
    "文本转语音": "Text to speech",
    "语音转文本": "Speech to text",
    "音色复刻": "Voice cloning",
    "音色列表": "Voice list",
    "删除音色": "Delete voice",
    "文档解析": "Document parsing",
    "查询异步结果": "Async result lookup",
    "视频生成（异步）": "Async video generation",
}


def humanized(name: Column) -> Column:
    return F.initcap(F.trim(F.translate(name, "_-", "  ")))


def english_display(label: Column, fallback: Column) -> Column:
    """A label with Chinese and no Latin letter in English: from the list, else the fallback; other labels as they are."""
    chinese = label.rlike("[㐀-鿿]") & ~label.rlike("[A-Za-z]")
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in ENGLISH.items() for x in pair]), label)
    return F.when(chinese, F.coalesce(known, fallback)).otherwise(label)


def private_address(host: Column) -> Column:
    """Whether a host is an IPv4 literal that isn't public; names would need DNS and give null."""
    parts = F.transform(F.split(host, r"\."), lambda p: p.try_cast("int"))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    local = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))
    return F.when(host.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), local)

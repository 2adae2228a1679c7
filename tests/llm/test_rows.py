"""Url filter, quality rules, WARC bundles and chat formats."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marktlens.llm import chat, fertility, url_filter, warc


def test_rules(spark):
    cases = {
        "https://A.example.org/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://x.org/p?q#f": ("x.org", "/p", "org/", "allow"),
        "http://x.org": ("x.org", "", None, "allow"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "https://m.casino-win.example.net/en/9": ("m.casino-win.example.net", "/en/9", None, "block"),
        "https://m.casino-win.example.com/fr/9": ("m.casino-win.example.com", "/fr/9", "com/fr/", "allow"),
        "no url": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    pages = spark.createDataFrame([(u, 1) for u in cases], "url string, listed int").drop("listed")
    listed = spark.createDataFrame([(k,) for k in url_filter.LISTED], "key string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, listed).collect()}
    assert got == cases
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, listed.limit(0), rules=()).collect()} == {"allow"}


def test_rules_beside_clashing_columns(spark):
    """Columns with the names of results give way to them; all others stay."""
    pages = spark.createDataFrame([(1, "http://x.org/p", "mine", "own", 2, 3, 4, 5, 6)], "page_id long, url string, says string, keys string, HOST int, path int, rule int, verdict int, __says int")
    got = url_filter.judge_urls(pages, spark.createDataFrame([("x.org",)], "key string"))
    assert got.columns == ["page_id", "url", "says", "keys", "__says", "host", "path", "rule", "listed", "verdict"]
    assert tuple(got.first()) == (1, "http://x.org/p", "mine", "own", 6, "x.org", "/p", "org/", True, "allow")


@pytest.mark.parametrize("most", [8 << 20, 300])
def test_cascade_is_exact(spark, most):
    rng = random.Random(7)
    hosts = [f"h{i}.net" for i in range(2500)]
    listed = rng.sample(hosts, 200) + ["absent.net", "h1.net/only"]
    pages = spark.createDataFrame([(f"http://www.{h}/only",) for h in hosts], "url string")
    found = url_filter.judge_urls(pages, spark.createDataFrame([(k,) for k in listed], "key string"), rules=(), max_level_bytes=most)
    want = {f"www.{h}" for h in hosts if h in listed}
    assert {r.host for r in found.where("listed").collect()} == want and found.count() == len(hosts)


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for k in range(len(words) - 4):
        at.setdefault(tuple(words[k : k + 5]), []).append(k)
    twice = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice)


@given(st.text(alphabet="ab #\n\té", max_size=120))
@settings(max_examples=200, deadline=None)
def test_base_counts(text):
    assert fertility.base_counts(text) == brute_counts(text)


def test_quality(spark):
    prose = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew strong coffee near an old stone bridge. " * 1
    docs = [(1, prose + "Every morning the baker opens his small shop and sells fresh bread to the people of the town. " + "A river runs past green hills, carrying leaves towards the distant sea under a pale autumn sky.", "en"), (2, None, None), (3, "word " * 200, "en"), (4, "%%% ### $$$ &&& *** " * 40, "en"), (5, "few words only", None), (6, "привет мир " * 3, "ru")]
    got = {r.doc_id: r for r in fertility.rate_quality(spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("n_words", F.lit(0))).collect()}
    assert got[1].kept and got[1].in_band and got[1].n_words == len(docs[0][1].split())
    assert not got[2].kept and got[2].n_words == 0 and got[2].base_failed
    assert got[3].base_failed and not got[3].in_band and not got[4].kept
    assert got[5].base_failed and got[6].script == "Cyrillic"
    assert fertility.rate_quality(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def merged(raw, ranks):
    """Byte pairs merged by hand: always the first pair of least rank."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        pairs = [(ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]  # noqa: B905
        rank, i = min(pairs, default=(1 << 30, 0))
        if rank == 1 << 30:
            return parts
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_fertility_by_hand(spark):
    """Characters a token, byte share and entropy, and the verdict, against merges and counts by hand."""
    import base64
    from collections import Counter
    from math import log2, sqrt
    from pathlib import Path

    import regex
    import sentencepiece

    folder = Path(fertility.TOKENIZERS)
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in (folder / fertility.BYTE_VOCABULARY).read_bytes().splitlines())}
    pieces = sentencepiece.SentencePieceProcessor(model_file=str(folder / fertility.PIECE_VOCABULARY))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).select("doc_id", "text", "lang")
    odd = [(-1, "", "en"), (-2, None, None), (-3, "a", "fr"), (-4, "##", None), (-5, "привет мир", "ru"), (-6, "日本語の文", None), (-7, "word " * 60_000, "en"), (-7, "x", "xx"), (-8, "%%% ### $$$ " * 90, "de")]
    frame = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = {(r.doc_id, r.text_md5): r for r in fertility.rate_quality(frame.withColumn("text_md5", F.md5("text"))).collect()}
    assert len(got) == frame.count()
    for r in frame.collect():
        mine, text = got[r.doc_id, r.text and hashlib.md5(r.text.encode()).hexdigest() or (None if r.text is None else hashlib.md5(b"").hexdigest())], r.text or ""
        if len(text) > 20_000:
            assert mine.n_words == 60_000
            continue
        n = sum(len(merged(w.encode(), ranks)) for w in regex.findall(fertility.PATTERN, text))
        found = Counter(pieces.encode(text, out_type=str))
        whole = sum(found.values())
        assert mine.n_tokens == n
        if not n or not whole:
            assert mine.in_band == (n == 0) and mine.entropy is None
            continue
        share = sum(c for p, c in found.items() if regex.fullmatch("<0x[0-9A-F]{2}>", p)) / whole
        entropy = -sum(c / whole * log2(c / whole) for c in found.values())
        assert (mine.chars_per_token, mine.byte_share, mine.entropy) == pytest.approx((len(text) / n, share, entropy))
        (low, high), most, least = fertility.BANDS[r.lang if r.lang in fertility.BANDS else mine.script if mine.script in fertility.BANDS else "other"]
        s = 6 / sqrt(n)
        assert mine.in_band == (low / (1 + s) <= len(text) / n <= high * (1 + s) and share <= most + s and entropy >= least * (1 - s)), r.doc_id
        assert mine.kept == (mine.in_band and not mine.base_failed)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u\r\n", None), (2, None, ""), (3, "x", "é\r\n\r\nWARC/1.1"), (7, "y", "é\r\n\r\nWARC/1.1"), (7, "y", "é\r\n\r\nWARC/1.1"), (None, "z", "é\r\n\r\nWARC/1.1"), (None, "q", "zz"), (9, "big", "b" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit(1))
    for least in (0, 5):
        index = warc.write_warc(pages, str(tmp_path / f"w{least}"), frame_bytes=500, bundle_bytes=2000, min_dedup_bytes=least)
        got = sorted((str(r.id), r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload) if r.payload is not None else None) for r in warc.read_warc(index).collect())
        text = "é\r\n\r\nWARC/1.1".encode()
        want = [("1", "revisit", 2, 0, None) if least == 0 else ("1", "response", None, 0, b""), ("2", "response", None, 0, b""), ("3", "revisit", 7, len(text), None), ("7", "response", None, len(text), text), ("7", "response", None, len(text), text), ("9", "response", None, 200_000, b"b" * 200_000), ("None", "response", None, 2, b"zz"), ("None", "revisit", 7, len(text), None)]
        assert sorted(got, key=str) == sorted(want, key=str)
    urls = {r.url for r in warc.read_warc(warc.write_warc(spark.createDataFrame([(1, "", "a"), (2, None, "b"), (3, " x ", "c")], "page_id long, url string, html string"), str(tmp_path / "urls"))).collect()}
    assert urls == {"", None, " x "}
    bundle = index.where("id = 9").first()
    reader = warc.BundleReader(bundle.bundle)
    raw = reader.frame(bundle.frame)[bundle.offset : bundle.offset + bundle.length]
    fields, block = warc.parse_record(raw)
    assert fields["warc-payload-digest"] == "sha1:" + warc.digest(b"b" * 200_000) and block.endswith(b"b" * 200_000)
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(open(bundle.bundle, "rb"), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert warc.read_warc(warc.write_warc(pages.limit(0), str(tmp_path / "none"))).count() == 0


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(11)
    bits = ["\\", "#", "##", "###", "</turn>", "<", "\n", ":", " ", "turn>", "### user: ", "a", "é", ""]
    text = lambda: "".join(rng.choices(bits, k=rng.randint(0, 7)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "we:ird", "a\\"]), text()) for c in range(120) for t in range(rng.randint(1, 4))]
    rows += [(900, 0, None, None), (None, 0, "user", "x"), (901, 1, "user", "b"), (901, 1, "user", "a"), (901, 1, "user", "a"), (901, None, "user", "first"), (902, 0, "assistant", "long " * 50_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("said", F.lit(1)).withColumn("formatted", F.lit(2))
    got = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted(((-1 if t is None else t, role or "", x or "") for c, t, role, x in rows if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [w[1:] for w in want], conv
        plain = lambda x: re.sub(r"\\([\s\S])", r"\1", x)
        assert [plain(got[conv].formatted[s.start : s.start + s.length]) for s in got[conv].spans] == [w[2] for w in want if w[1] == "assistant"], conv
        for w in want:
            assert got[conv].level > 0 or not ("</turn>" in w[2] or "###" in w[2])
    assert chat.format_chats(frame.limit(0)).count() == 0
    for level in (1, 2):
        said = frame.select(F.array(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("s"))
        assert said.where(~(chat.parsed(chat.rendered(F.col("s"), level)) == F.col("s"))).count() == 0

"""Media, PII, token files, SentencePiece, language, scoring and page text against plain versions."""

from __future__ import annotations

import hashlib
import html
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quantloom.llm import mixing
from quantloom.llm.htmltext import main_text, page_texts
from quantloom.llm.language import BUCKETS, LanguageModel, codewords, keep_identified, language_report
from quantloom.llm.media import WIDTH, header_of, media_columns, padded, payload_of, png_of
from quantloom.llm.pieces import PieceModel, encoded, message, piece_report
from quantloom.llm.pii import pii_report, redact, redacted, spans_of
from quantloom.llm.tokenfile import decode_block, encode_block, pack, token_file_columns, unpack


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def both(documents, odd):
    return documents.select("doc_id", "text", "lang").union(odd.select("doc_id", "text", "lang"))


# --- media


def test_media_columns(both, none):
    want = Counter()
    for i, t in pairs(both):
        data = (t or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        want[i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    rows = media_columns(both).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    same = {}
    for r in rows:
        assert same.setdefault(r["payload_sha256"], (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
    assert media_columns(none).count() == 0


@pytest.mark.parametrize("data", [b"", b"x", bytes(range(256)) * 9, b" " * 192])
def test_png_round_trip(data):
    payload = padded(data)
    png = png_of(payload)
    assert payload_of(png) == payload and header_of(png[:33])[0] == WIDTH


# --- PII

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    return {k: [m.span() for m in p.finditer(text or "") if valid(k, m[0])] for k, p in BASE.items()}


def test_pii_report(both, none):
    want = Counter()
    for i, t in pairs(both):
        s = brute_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in s[k])
        want[i, *(len(s[k]) for k in BASE), hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in pii_report(both).collect()) == want
    assert pii_report(none).count() == 0


@pytest.mark.parametrize("text", ["a@b@c.d x@y.zz.", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.04", "4111-1111 1111 1111 4111111111111112", "+1 (23) 456-789 0+49 30 1234567", "..a@@b.c +++12 3.4", "é@b.c 1..2.3.4.5"])
def test_pii_edges(text):
    found = spans_of(text)
    assert {k: found[k] for k in BASE} == brute_spans(text)


def test_redaction(odd, none):
    assert redacted("write to a.b@c.de now") == "write to [EMAIL] now" and redacted(None) is None
    out = redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and redact(none).count() == 0
    assert not any(spans_of(t)["email"] for _, t in pairs(out))


# --- token files


def test_packing():
    values = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    assert (unpack(*pack(values), len(values)) == values).all()
    import pyarrow as pa

    ids = values % 50_000
    table, back = decode_block(encode_block(pa.array([3, None], pa.int64()), [4, 5], ids))
    assert table.column(0).to_pylist() == [3, None] and (back == ids).all()


def test_token_files(both, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = sorted(pairs(both), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = Counter(), 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert Counter(map(tuple, token_file_columns(both, path).collect())) == want
    assert token_file_columns(none, path).count() == 0


# --- SentencePiece


def test_pieces_match_the_library(both, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want, texts = Counter(), {}
    for i, t in pairs(both):
        ids = library.encode(t or "")
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
        texts[i] = t
    rows = piece_report(both, path).collect()
    assert Counter(tuple(r)[:4] for r in rows) == want
    assert sum(r["round_trip"] for r in rows) >= len(rows) - 2
    assert {r["doc_id"]: r["decoded"] for r in encoded(both, path).collect()}[5] == texts[5]
    assert piece_report(none, path).count() == 0
    with open(path, "rb") as file:
        assert len(PieceModel.parse(file.read()).pieces) == 32_000


def field(number, value):
    """A protobuf field: an integer, or bytes."""

    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.mark.parametrize(("kind", "blanks"), [(1, 1), (1, 0), (2, 1)])
def test_whole_text_models(spark, tmp_path, both, kind, blanks):
    # the public model's pieces as a unigram (1) or BPE (2) model with a normaliser map; blanks are removed or kept
    import sentencepiece

    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    charsmap = next(dict(message(v))[2] for k, v in message(normalizer.serialized_model_proto()) if k == 3)
    parts = []
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        for n, own in enumerate(dict(message(v)) for k, v in message(file.read()) if k == 1):
            # a unigram model's scores: falling with the rank, and hardly ever equal in sum
            score = struct.pack("<f", -1.3 * math.log(3 + n) - n * 0.6180339 % 1) if kind == 1 and own.get(3, 1) == 1 else own[2]
            parts.append(field(1, field(1, own[1]) + b"\x15" + score + field(3, own.get(3, 1))))
    trainer, rules = field(3, kind) + field(35, 1), field(1, b"nmt_nfkc") + field(2, charsmap) + field(3, 1) + field(4, blanks) + field(5, 1)
    path = str(tmp_path / "own.model")
    with open(path, "wb") as file:
        file.write(b"".join(parts) + field(2, trainer) + field(3, rules))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = piece_report(both, path).collect()
    want = Counter()
    for i, t in pairs(both):
        ids = library.encode(t or "")
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:4] for r in rows) == want
    assert np.mean([r["parity"] for r in rows]) > 0.95


# --- language


def test_language_held_out_accuracy(documents, none):
    truth = {r["doc_id"]: r["lang"] for r in documents.where("lang IS NOT NULL").collect()}
    rows = [r for r in language_report(documents).collect() if r["held_out"] and r["doc_id"] in truth and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows) and language_report(none).count() == 0
    code = codewords(9)
    assert min((a != b).sum() for k, a in enumerate(code) for b in code[:k]) >= 3


def test_language_odd_rows(both, odd, none):
    found = {r["doc_id"]: r for r in language_report(both).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 3))
    assert {r["lang_pred"] for r in language_report(odd.withColumn("lang", odd["lang"].substr(9, 1)).replace("", None, ["lang"])).collect()} == {"und"}
    assert keep_identified(odd).columns == odd.columns and keep_identified(none).count() == 0


def test_languages_that_no_bit_tells_apart():
    counts = np.ones((3, BUCKETS))
    for names, own in ((["aa", "bb"], counts[:2]), (["aa", "bb", "cc"], counts * [[1], [1], [5]])):
        lang, score, lead = LanguageModel.from_counts(names, own).predict(["the same words in either", None])
        assert (lang, lead) == (["aa", "und"], [0.0, 0.0]) and score == [pytest.approx(1 / len(names)), 0.0]


def test_more_languages_than_a_model_learns(spark, monkeypatch):
    monkeypatch.setattr("quantloom.llm.language.MAX_LANGUAGES", 2)
    rows = [(k, f"{word} " * n, lang) for k, (word, n, lang) in enumerate([("alpha", 9, "a"), ("beta", 5, "b"), ("gamma", 1, "c")] * 5)]
    found = language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in found} == {"a", "b"}


def test_without_any_language_texts_with_letters_stay(odd):
    kept = keep_identified(odd.withColumn("lang", odd["lang"].substr(9, 1)).replace("", None, ["lang"]))
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {None, 4, 5, 6, 7, 8, 9}


# --- scoring


def test_base_scores(both, none):
    def tokens(t):
        return [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]

    rows, counts = pairs(both), Counter()
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0 for i, _ in rows]
    for (_, t), h in zip(rows, held):
        if not h:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, h, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(math.fsum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 5)) for (i, t), h in zip(rows, held))
    found = mixing.score_report(both).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in found)
    assert len(got) == len(want) and all(a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 for a, b in zip(got, want))
    # better on unseen texts than single bytes by their frequency
    seen = Counter(b for (_, t), h in zip(rows, held) if not h for b in (t or "").encode())
    total = sum(seen.values())
    plain = sum(math.log10((seen[b] + 0.1) / (total + 25.6)) for (_, t), h in zip(rows, held) if h for b in (t or "").encode())
    assert plain < sum(r["score"] for r in found if r["held_out"]) < 0
    assert all(r["score"] <= 0 for r in found) and mixing.score_report(none).count() == 0


def plain_chunks(text):
    """(bytes before, chunk and whether it ends the text) of each chunk, byte by byte."""
    out, start = [], 0
    data = (text or "").encode()
    for k in range(len(data)):
        code = int.from_bytes((mixing._START + data)[k + 2 : k + 8], "big")
        if data[k] in b"\t\n\x0b\x0c\r " and code * 0x9E3779B97F4A7C15 % 2**64 >> 40 & mixing.CUT - 1 == 0:
            out.append((data[max(start - mixing.REACH, 0) : start], data[start : k + 1], False))
            start = k + 1
    return [*out, (data[max(start - mixing.REACH, 0) : start], data[start:], True)]


def test_copied_chunks_match_brute_force(both):
    rows = pairs(both)
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0 for i, _ in rows]
    seen = Counter(c for (_, t), h in zip(rows, held) if not h for c in plain_chunks(t))
    want = Counter((i, sum(seen[c] > (not h) for c in plain_chunks(t))) for (i, t), h in zip(rows, held))
    assert Counter((r["doc_id"], r["n_copied"]) for r in mixing.score_report(both).collect()) == want
    assert sum(n for _, n in want) > 100


def test_every_training_document_is_counted_and_fitted(spark):
    def model(texts):
        docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
        rows = mixing.gather(docs).where("run IS NOT NULL")
        counts = mixing._slot_counts(rows.groupBy("run").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(2 * mixing.ROW))))
        return counts, mixing.fitted(docs, counts)

    texts = [f"document {k} has the number {k * k} and {'many ' * k}words of its own" for k in range(12)]
    counts, whole = model(texts)
    assert (counts.sum((1, 2)) == 8 * sum(len(t) + 1 for t in texts)).all()
    fresh = mixing.Mixer.fresh()
    assert all((whole.weights.reshape(8, -1) != fresh.weights.reshape(8, -1)).any(1)) and (whole.refined != fresh.refined).any()
    for k in (0, 5, 11):  # each one moves what is fitted, with the same counts
        fewer = mixing.fitted(spark.createDataFrame([(t,) for i, t in enumerate(texts) if i != k], "text string").coalesce(1), counts)
        assert abs(fewer.weights - whole.weights).max() > 1e-6


def test_a_piece_is_left_out_of_the_counts_it_is_fitted_with():
    code, times = mixing._counted(mixing._codes([b"one text, and the same text once more, text"])[0])
    own = np.zeros((len(mixing.ORDERS), mixing._SLOTS, 2), np.float32)
    mixing._add(own, code, times)
    other = np.zeros_like(own)
    mixing._add(other, *mixing._counted(mixing._codes([b"quite another text and one more"])[0]))
    seen = []
    fitted = mixing.Mixer.fresh()
    plain = mixing.Mixer._inputs
    fitted._inputs = lambda reduced, look: ((seen.append(given), (given, longest))[1] for given, longest in plain(reduced, look))
    fitted.learn(code, times, own + other)
    want = plain([mixing._reduced(code, k) for k in range(len(mixing.ORDERS))], lambda k, slots, bit: mixing._odds(other[k, slots, 0], other[k, slots, 1]))
    assert len(seen) == 8 and all((a == b).all() for a, (b, _) in zip(seen, want)) and any((a[:-1] != 0).any() for a in seen)


def test_words_are_cut_as_bytes_are():
    texts = [b"", b" \t", b"one", b" Two\x0bTWO\x0c\xc3\x89t\xc3\xa9\x1c\x85\xc2\xa0x\n", b"\x00 a\x00b \xed\xa0\x80", b"", b"last\r\nwords "]
    words, ends = mixing._words(texts)
    assert [words[a:b].to_pylist() for a, b in zip(ends[:-1], ends[1:])] == [t.lower().split() for t in texts]
    assert [len(x) for x in mixing._words([])] == [0, 1]


def test_counters_stay_right_where_words_and_slots_are_given_out_early(spark, monkeypatch):
    texts = [f"document {k} has the number {k * k} and {'many ' * k}words of its own" for k in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)

    def sums():
        rows = mixing.gather(docs)
        words = rows.where("words IS NOT NULL").select(F.inline(F.arrays_zip("words", "times"))).groupBy("words").agg(F.sum("times")).collect()
        slots = rows.where("run IS NOT NULL").groupBy("run").agg(*(F.sum(f"n{k}") for k in range(2 * mixing.ROW))).collect()
        return {bytes(w): n for w, n in words}, sorted(slots), rows.where("run IS NOT NULL").count(), rows.where("words IS NOT NULL").count()

    words, slots, n_slots, n_words = sums()
    assert words == Counter(w for t in texts for w in t.encode().split()) + Counter({mixing.END: len(texts)})
    gather = mixing.gather

    def early(docs):
        monkeypatch.setattr(mixing, "PIECE", 300)
        monkeypatch.setattr(mixing, "HELD_WORDS", 20)
        monkeypatch.setattr(mixing, "HELD_BYTES", 1000)
        return gather(docs)

    monkeypatch.setattr(mixing, "gather", early)
    found = sums()
    assert found[:2] == (words, slots) and found[2] > n_slots and found[3] > n_words


def test_scores_in_blocks_are_those_of_single_codes():
    code, times = mixing._counted(mixing._codes([bytes(np.random.default_rng(3).integers(97, 123, 5000).astype(np.uint8)), b"", b"more text"])[0])
    counts = np.zeros((len(mixing.ORDERS), mixing._SLOTS, 2), np.int32)
    mixing._add(counts, code, times)
    mixer = mixing.Mixer.fresh(mixing._odds(*(counts[..., k].astype(np.float32) for k in (0, 1))))
    shared = np.resize(code, mixing.BLOCK + len(code) // 2)  # over the end of a block
    whole = mixer.log10(shared)
    assert abs(whole[: len(code)] - [mixer.log10(code[k : k + 1])[0] for k in range(len(code))]).max() < 1e-5
    assert (whole == np.resize(whole[: len(code)], len(whole))).all() and mixer.log10(code[:0]).size == 0


def test_codes_take_little_memory():
    import tracemalloc

    mixing._codes([b"first"])
    texts = [b"some words of a text " * 5000] * 20
    tracemalloc.start()
    code, _ = mixing._codes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * code.nbytes  # 2.25 times where all codes were held twice


def test_scores_beat_the_base_score(spark):
    found = mixing.score_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert found.score.sum() > 0.9 * found.base_score.sum()


def test_scores_without_training_documents(spark):
    rows = [(k, f"some words {k}") for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0]
    found = mixing.score_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows) and all(r["held_out"] and r["train_tokens"] == r["n_known"] == r["n_copied"] == 0 and -200 < r["score"] < 0 for r in found)


# --- pages

PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><nav><ul><li>Home</li><li>About</li></ul></nav>
<div class="cookie-banner">We use cookies on this site and ask you to accept all of them now.</div>
<article><header><h1>Heading &amp; more</h1></header><p>First   paragraph of
the article&nbsp;text.</p><p>Second one.<br>Still.</p><aside>Advert</aside><section class="comments"><p>Nice post!</p></section></article>
<footer>Copyright</footer></body></html>"""


def test_main_text():
    text = main_text(PAGE)
    assert "First paragraph of the article text.\nSecond one. Still." in text
    assert not any(x in text for x in ("Home", "cookies", "Advert", "Nice post", "Copyright", "var a"))
    assert main_text(None) == main_text("") == main_text("<html></html>") == "" and main_text("<p>unclosed <b") in ("", "unclosed")


def labelled(page):
    """The text of a generated page's article, whose only blocks are h1 and p."""
    body = re.sub(r"<br>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in blocks if x)


def test_line_blocks_find_the_article(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    want = [labelled(p) for p in pages]
    assert [main_text(p) for p in pages] == want
    plain = [re.sub(r"<(/?)article>", r"<\1div>", p) for p in pages]
    assert [main_text(p) for p in plain] == want
    # nothing but the lengths of lines tells menu, advert and footer from text
    bare = [re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", p).replace(' class="ad"', "") for p in pages]
    right = np.mean([main_text(p) == t for p, t in zip(bare, want)])
    assert right > 0.95 and all(map(main_text, bare))
    monkeypatch.setattr("quantloom.llm.htmltext.WINDOW", 6)
    assert np.mean([main_text(p) == t for p, t in zip(bare, want)]) < right - 0.1


def test_pages_at_the_edges():
    menu = "<div><ul>" + "<li><a href=x>Somewhere to go</a></li>" * 9 + "</ul></div>"
    assert main_text(f"<body>{menu}<div><p>Short.</p></div>{menu}") == "Short."
    assert main_text(f"{menu}<div><p>Same text.</p><p>Same text.</p></div>{menu}") == "Same text.\nSame text."
    long = " ".join(f"word{k}" for k in range(50_000))
    assert main_text(f"{menu}<div><h1>Title</h1><p>{long}</p><p>End.</p></div><div>{menu}</div>") == f"Title\n{long}\nEnd."
    assert main_text(f"<article><h1>T</h1>{menu}<p>Text.</p></article>") == "T\nText." and main_text(menu) == ""


def test_page_texts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = page_texts(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in rows) and sum(r["n_chars"] > 0 for r in rows) > 0.9 * len(rows)
    odd = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>" * 3000 + "x")], "page_id long, url string, html string")
    assert page_texts(odd).count() == 3 and page_texts(pages.where("1 = 0")).count() == 0

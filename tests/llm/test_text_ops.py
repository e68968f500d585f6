"""Language, tokens, archives, chat, markup, licenses and fingerprints against direct definitions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayline.llm import bpe, chat, fingerprints, html_text, langid, licenses, token_output, warc
from wayline.llm.catalog import ORACLE, QUERIES
from wayline.llm.common import shared_folder

DATA = "/root/testdata/sf0.001"
EXTRA = "doc_id bigint, text string, lang string, ids string, decoded string, score string, t int, key string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "x", "y", "z", 1, "k") for i, t, lang in rows], EXTRA)


ODD = [(1, None, "en"), (2, "", "en"), (3, "  \n ", None), (4, "don't  stop\n\n 12,5é", "en"), (4, "don't  stop\n\n 12,5é", "en"),
       (None, "no id <|endoftext|> here", "en"), (5, "word " * 4000 + "x" * 3000, "en"), (6, "🙂🙃 日本語\x1c!\x1c? ñandú", None)]


def test_registered_sql(spark):
    assert set(ORACLE) <= set(QUERIES) and len([q for q in QUERIES if q.startswith("op")]) == 13


def test_bpe_matches_the_library(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = bpe.round_trip(table(spark, ODD), P.path("byte_bpe_50k.json")).collect()
    assert len(out) == len(ODD) and {"ids", "decoded", "lang", "key"} <= set(out[0].asDict())
    for r in out:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.round_trip(table(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_bpe_on_random_strings():
    library, coder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.Encoder(bpe.load(P.path("byte_bpe_50k.json")))
    random.seed(3)
    bits = ["a", "th", "the ", " ", "  ", "\n", "'s", "é", "́", "🙂", "1", "!", "\t", "\xa0", "<|endoftext|>", "ZZ", "\x1d"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 50))) for _ in range(3000)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(coder.encode(t), np.int32).tolist() == e.ids


def test_bpe_words_of_a_batch_are_worked_out_together(monkeypatch):
    library, coder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.Encoder(bpe.load(P.path("byte_bpe_50k.json")))
    monkeypatch.setattr(bpe, "WORD_CACHE", 60)
    calls, short = [], coder._short
    monkeypatch.setattr(coder, "_short", lambda words: calls.append(len(words)) or short(words))
    random.seed(4)
    bits = ["a", "th", "ing", "é", "日本語", "🙂", "12", "'s", "!", "ZZ", "\n", "\t"]
    words = ["".join(random.choices(bits, k=random.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(random.choices(words, k=20)) for _ in range(100)] + ["", " a  b ", "x" * 2500 + "éß" * 700, "one<|endoftext|> two <|endoftext|>", "<|endoftext|>"]
    for _ in range(2):
        ids, ends = coder.encode_all(texts)
        assert len(calls) <= 2 and sum(calls) > 0
        calls.clear()
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
        assert coder.decode_all(ids, ends).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in want]
    assert max(len(coder.known), len(coder.spaced)) <= 60
    # halves of characters
    odd = [want[i][::2] for i in range(100)]
    flat, stops = np.concatenate([np.array(x, np.int32) for x in odd]), np.cumsum([len(x) for x in odd])
    assert coder.decode_all(flat, stops).to_pylist() == [b"".join(coder.t.tokens[i] for i in x).decode("utf-8", "replace") for x in odd]


def test_bpe_decode(spark):
    rows = spark.createDataFrame([(1, [15496, 995]), (2, []), (3, None), (4, [50256, 128])], "id int, ids array<int>")
    got = {r.id: r.decoded for r in bpe.decode(rows, P.path("byte_bpe_50k.json")).collect()}
    assert got[1] == "Hello world" and got[2] == "" and got[3] is None and got[4].startswith("<|endoftext|>")


def test_token_output(spark, monkeypatch):
    monkeypatch.setattr(token_output, "FILE", 3000)
    monkeypatch.setattr(token_output, "BLOCK", 500)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = token_output.round_trip(table(spark, ODD), P.path("word_bpe_49k.json"), 2).collect()
    assert len(got) == len(ODD)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n == len(r.ids) // 4
        at += r.n
    order = [r.id for r in sorted(got, key=lambda r: r.start)]
    assert order == [None, 1, 2, 3, 4, 4, 5, 6]
    want = Counter((i, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], np.uint32).tobytes()) for i, t, _ in ODD)
    assert Counter((r.id, bytes(r.ids)) for r in got) == want
    assert token_output.round_trip(table(spark, []), P.path("word_bpe_49k.json"), 2).count() == 0


@pytest.mark.parametrize("limit", [10**6, 40])
def test_words_match_the_library(monkeypatch, limit):
    """Random texts over cases, marks, digits, quotes, scripts, combining marks, control strings and white space of all kinds."""
    monkeypatch.setattr(token_output, "WORD_CACHE", limit)
    library, coder = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_output._Words(P.path("word_bpe_49k.json"))
    rng = random.Random(limit)
    bits = [*"aeinrstABEIST019'’‘“”\"()<|>.,;!?-_/", *"İıſßéÀÇµª²¼ǅΣςσЖøÅ漢🙂", "\u0301", "\u0307", "\u212b", "\u212a", "\xad", "\u200b",
            "<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "'s", "'S", "'re", "'LL", "n't", "don't", "L’été,", "A.B."]
    space = [*"    \n\t\r\x0b\x0c\x85\xa0", "\u2003", "\u2028", "\u3000", "\x1c", "\x1f"]
    texts = ["".join(rng.choice(bits if rng.random() < 0.8 else space[: rng.choice([8, len(space)])]) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["“ALİ,", "“BELGESİ.", "“AL’İ,", "İ.", "", " ", "a" * 5000 + " İ,"]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        stops, ids = coder.encoded(pa.array(["left out", *some]).slice(1), np.uint32(2).tobytes())
        for t, a, b in zip(some, stops[:-1].tolist(), stops[1:].tolist()):
            assert ids[a:b].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], t


def test_code_lengths():
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    for limit in (5, 8, 16, 32):
        n = token_output.code_lengths(np.array([0, *fib]), limit)
        assert n[0] == 0 and n.max() <= limit and sum(2.0 ** -int(x) for x in n[1:]) == 1.0
    # unlimited: the cost of Huffman's tree
    import heapq

    heap, cost = list(fib), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert int((token_output.code_lengths(np.array(fib), 32).astype(int) * np.array(fib)).sum()) == cost
    assert token_output.code_lengths(np.array([0, 7])).tolist() == [0, 1]
    with pytest.raises(ValueError):
        token_output.code_lengths(np.ones(5, int), 2)


def test_pack_and_unpack():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.05, 5000) - 1, 300).astype(np.uint32)
    ends = np.array([0, 0, 1, 700, 700, 5000])
    lengths = token_output.code_lengths(np.bincount(ids))
    stream, starts, marks = token_output.pack(ids, ends, token_output.canonical(lengths), lengths)
    at = np.concatenate([m + 8 * s for m, s in zip(marks, starts[:-1])])
    n = np.diff(ends)
    count = np.concatenate([[min(token_output.MARK, k - i) for i in range(0, k, token_output.MARK)] for k in n.tolist()]).astype(np.int64)
    assert (token_output.unpack(stream, at, count, token_output.decode_table(lengths)) == ids).all()


def test_language_id(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify(docs).join(docs.select(F.col("doc_id").alias("id"), "lang", "text"), "id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) <= 0.01 * len(got)


def test_language_id_odd_rows(spark):
    base = [(i, f"the house and the garden number {i} are there with them", "en") for i in range(10, 60)]
    base += [(i, f"das haus und der garten nummer {i} sind nicht weit von uns", "de") for i in range(60, 110)]
    odd = [(200, None, "en"), (201, "", "de"), (202, "123 !?", "en"), (203, "zxqj vkwx qzzx jjxq wvxq zkqj xxvq qqzj", "en"), (None, "the house", "en"), (10, base[0][1], "en")]
    got = {r.id: r for r in langid.identify(table(spark, base + odd)).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in (200, 201, 202))
    assert got[203].rejected and got[203].lang_pred in ("en", "de")
    assert got[None].lang_pred == "en" and got[None].held_out is False and not got[10].rejected
    assert langid.identify(table(spark, [])).count() == 0
    alone = langid.identify(table(spark, [(1, "some text", None)])).first()
    assert alone.lang_pred == "und" and alone.rejected


def test_model_probabilities_sum_to_one(spark):
    rows = spark.createDataFrame([(i, "en", "banana bandana cabana") for i in range(30)], "id bigint, lang string, text string")
    model = langid.train(rows)
    chars = np.array([ord(c) for c in "abcdn "], np.uint32)
    for context in ("    ", "   b", "bana", "nana"):
        points = np.array([[*map(ord, context), c] for c in chars], np.uint32)
        total = np.exp(model.log_prob(points)).sum()
        assert 0.8 < total <= 1.0001, (context, total)


def test_warc(spark):
    big = "<p>é" + "x" * 200 + "</p>"
    pages = spark.createDataFrame(
        [(5, "http://a/\r\nX: 1", big, 1), (2, None, big, 1), (9, "http://c", big, 1), (1, "u", None, 1), (3, "u", "", 1), (4, "v", "short", 1), (6, "v", "short", 1)],
        "page_id bigint, url string, html string, digest int")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), 1: ("response", None), 3: ("response", None), 4: ("response", None), 6: ("response", None)}
    assert all(r.payload_digest == hashlib.sha256((big if i in (2, 5, 9) else "short" if i in (4, 6) else "").encode()).hexdigest() for i, r in got.items())
    assert got[5].url == "http://a/\r\nX: 1" and got[2].url is None and got[2].payload_bytes == len(big.encode())
    folder = shared_folder(spark, "warc-test")
    warc.write_archive(pages, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    whole = {r.page_id: r for r in warc.records(spark, folder).collect()}
    head, _, rest = bytes(whole[2].record).partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and rest == big.encode() + b"\r\n\r\n"
    assert bytes(whole[9].payload) == big.encode() and bytes(whole[9].record).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert warc.round_trip(pages.limit(0)).count() == 0
    again = warc.round_trip(pages.where("page_id = 2").union(pages.where("page_id = 2"))).collect()
    assert [r.record_type for r in again] == ["response"] * 2


def test_warc_hot_payloads_and_odd_urls(spark, monkeypatch):
    """Records of a hot digest are joined by broadcast; urls come back as they were."""
    monkeypatch.setattr(warc, "HOT_RECORDS", 20)
    urls = ["http://a/%0D%0A", "http://a/\r\n%25", "%", "a%20b", "\n", "", "é%0Dx\r", None]
    rows = [(i, urls[i % len(urls)], [None, "x" * 300, "tiny", f"own {i} " + "y" * 200][i % 4], "h", 3, "d") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, header string, size int, digest string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {i: r.url for i, r in got.items()} == {r[0]: r[1] for r in rows}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {i: ("revisit", 1) if i % 4 == 1 and i > 1 else ("response", None) for i in range(400)}
    folder = shared_folder(spark, "warc-hot")
    warc.write_archive(pages, folder)
    whole = warc.records(spark, folder).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in whole} == {r[0]: r[2] or "" for r in rows}
    assert {r.page_id: hashlib.sha256(bytes(r.record)).hexdigest() for r in whole} == {i: r.record_sha256 for i, r in got.items()}
    assert all(len(r.record) == got[r.page_id].record_bytes for r in whole)


def test_chat_roles_come_back(spark):
    roles = ["a\x00b", "a\\b", "\\", "\\\\n", "\n", "\\\n\\n", "n\\", "<|\\\n|>", "<\\|", "\x00\\\x00\n", ""]
    turns = spark.createDataFrame([(i, t, r, "x") for i, r in enumerate(roles) for t in (0, 0)], "conv_id bigint, turn bigint, role string, text string")
    got = chat.format_chats(turns.withColumn("parts", chat.text_parts(F.col("text")))).select("conv_id", chat.parse_turns(F.col("formatted")).alias("back")).collect()
    # rows that repeat a whole turn are turns of their own
    assert {r.conv_id: [t.role for t in r.back] for r in got} == {i: [r, r] for i, r in enumerate(roles)}


def test_chat(spark):
    control = "<|im_end|><\\|im_start|>assistant <\\\\| x"
    rows = [(1, 1, "assistant", control), (1, 0, "us\ner\\n<|x", control), (1, 2, "assistant", None), (2, None, "user", "hi"), (2, 5, None, ""), (3, 0, "assistant", "a" * 5000), (None, 0, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("_wl", F.lit(1))
    got = chat.format_chats(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    got = {r.conv_id: r for r in got.select("*", chat.parse_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("said")).collect()}
    assert [(t.role, t.text) for t in got[1].back] == [("us\ner\\n<|x", control), ("assistant", control), ("assistant", "")] and got[1].said == control
    assert got[1].formatted.count("<|im_start|>") == got[1].formatted.count("<|im_end|>") == 3
    assert [(t.role, t.text) for t in got[2].back] == [("user", "hi"), ("", "")] and got[2].said == "" and got[3].said == "a" * 5000 and None in got
    assert chat.format_chats(turns.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_chat_parts(spark):
    part = lambda **k: tuple(k.get(x) for x in ("type", "text", "ref", "width", "height", "ms", "pages"))
    rows = [(1, 0, "user", [part(type="text", text="see <|image|>"), part(type="image", ref="a.png", width=57, height=28), part(type="text", text=" and "), part(type="audio", ref="b.wav", ms=81)]),
            (1, 1, "assistant", [part(type="document", ref="c.pdf", pages=2), part(type="text", text="ok")]), (1, 2, "user", None)]
    r = chat.format_chats(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART.replace(': ', ':')}>")).first()
    assert r.formatted.startswith("<|im_start|>user\nsee <\\|image|><|image|> and <|audio|><|im_end|>\n<|im_start|>assistant\n<|document|>ok<|im_end|>\n")
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 3), ("document", "c.pdf", 1024)]
    for a in r.attachments:
        assert r.formatted[a.place :].startswith(chat.PLACEHOLDERS[a.type])
    assert [r.formatted[s.start : s.start + s.chars] for s in r.loss] == ["<|document|>ok"]


PAGE = ("<html><head><title>t</title></head><body><header>Site</header><div id='cookie-notice'>We use</div><nav><a href=x>Menu</a></nav>{main}"
        "<aside>Side</aside><section class=\"comments\"><article>c1</article></section><form>f</form><script>var a='</p>';</script><footer>&copy; x</footer></body></html>")


def test_page_lines():
    lines = html_text.page_lines(PAGE.format(main="<article><h1>A &amp; B</h1><p>One <i>two</i>&nbsp;\n three<p><b>Four<br>Five</article>"))
    assert html_text.main_text(lines, set()) == "A & B\nOne two three\nFour\nFive"
    assert html_text.main_text(html_text.page_lines("no <b>markup</b>  here"), set()) == "no markup here"
    assert html_text.page_lines("") == [] and html_text.page_lines("<p>") == [] and html_text.page_lines("<!-- <p>x</p>") == []
    assert html_text.page_lines("a < b <3 &lt;i&gt; <p") == [(1, "a < b <3 <i> <p")]


@pytest.mark.parametrize("halved", [html_text.HALVED, 12, 2])
def test_longest_common_lines(monkeypatch, halved):
    """Also when alignments are halved, down to a few line pairs."""
    monkeypatch.setattr(html_text, "HALVED", halved)
    random.seed(4)
    for _ in range(300):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 14))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        p, q = html_text.common_lines(a, b)
        assert [a[i] for i in sorted(p)] == [b[j] for j in sorted(q)] and len(p) == d[-1][-1]


def _site(n, make):
    return [(i, f"https://h.org/a/{i:04d}", f"<body>{make(i)}</body>") for i in range(n)]


def _texts(spark, rows):
    return {r.page_id: r.text.split("\n") if r.text else [] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_furniture_without_a_name_inside_articles(spark):
    """Only the alignment can tell it; passages that articles share stay, and so do lines of some of the pages."""
    passage = " ".join(f"quoted{k}" for k in range(60))
    story = lambda i: " ".join(f"body{i}word{k}" for k in range(80))

    def make(i):
        quote = f"<p>{passage}</p>" if i % 20 < 15 else ""
        some = "<p>Updated yesterday</p>" if i % 2 else ""
        return f"<article><header><h1>Title {i}</h1></header><p>Read our other stories</p><p>{story(i)}</p>{quote}{some}<p>End of {i}</p><div>Printed by the site</div></article>"

    got = _texts(spark, _site(60, make))
    for i in range(60):
        want = [f"Title {i}", story(i), *([passage] if i % 20 < 15 else []), *(["Updated yesterday"] if i % 2 else []), f"End of {i}"]
        assert got[i] == want, i
    # too few different pages to tell
    assert _texts(spark, _site(3, make))[1][1] == "Read our other stories"


def test_copies_are_passed_over(spark):
    """A page between copies is held against the next different pages."""
    body = lambda i: f"<div>Banner of ours</div><p>Story number {i} has words of its own {i * 7} and {i * 11}</p>"
    rows = [(i, f"https://h.org/a/{i:04d}", body(5 if 4 <= i <= 6 else i)) for i in range(12)]
    got = _texts(spark, rows)
    assert all(got[i] == [f"Story number {5 if 4 <= i <= 6 else i} has words of its own {(5 if 4 <= i <= 6 else i) * 7} and {(5 if 4 <= i <= 6 else i) * 11}"] for i in range(12))


def test_a_teaser_is_no_article(spark):
    rows = _site(8, lambda i: f"<article><h3>Teaser {i}</h3></article><div><p>{f'The main story {i} ' * 30}</p></div><div>Bottom line</div>")
    got = _texts(spark, rows)
    assert all(got[i] == [f"Teaser {i}", (f"The main story {i} " * 30).strip()] for i in range(8))


def test_parts_do_not_change_the_texts(spark, monkeypatch):
    """One rule at every size of a host: the same texts with one part and with many, hot host, long page and copies included."""
    rng = random.Random(3)
    lines = [f"<div>common {k}</div>" for k in range(6)]
    rows = []
    for i in range(300):
        own = "".join(rng.sample(lines, rng.randint(0, 4))) + f"<p>page {i} says {rng.random()}</p>"
        rows.append((i, f"https://{'hot' if i % 3 else f'h{i % 7}'}.org/{rng.randint(0, 40):03d}/{i % 5}", own if i % 11 else rows[-1][2] if rows else own))
    rows += [(7, rows[7][1], rows[7][2]), (900, "https://hot.org/020/x", "".join(f"<p>long {k} {rng.random()}</p>" for k in range(4000)) + lines[0]), (901, None, None), (None, "x", "<p>y")]
    table = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "page_id bigint, url string, html string, part int, guest int, key string").repartition(5)
    one = sorted((tuple(r) for r in html_text.extract(table).collect()), key=str)
    assert len(one) == len(rows)
    monkeypatch.setattr(html_text, "PART_BYTES", 2000)
    assert sorted((tuple(r) for r in html_text.extract(table).collect()), key=str) == one


def test_html_differencing(spark):
    open_page = lambda i: f"<div>Welcome to the site</div><div><p>Story {i} begins here with its own words {i * 7}</p></div><div>All rights reserved by us</div>"
    rows = [(i, f"https://h.org/a/{i}.html?x=1", open_page(i), 0) for i in range(6)]
    rows += [(10, "https://h.org/z", None, 0), (11, None, "<article>same</article>", 0), (12, None, "<article>same</article>", 0), (0, rows[0][1], rows[0][2], 0)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, part int")).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == f"Story {i} begins here with its own words {i * 7}" for i in range(6))
    assert text[10] == "" and text[11] == text[12] == "same"
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"][1]
    changed = mit.replace("merge", "join").replace("hereby ", "")
    rows = [(1, "x y. Released under the MIT License. Licensed under CC BY-NC 4.0.", "en"), (2, None, "en"), (3, "", None), (4, "word " * 3000 + changed + " end" * 50, "en"),
            (5, "Released under the GNU License", "en"), (5, "RELEASED under\nthe mit-license", "en"), (None, "Released under the MIT License " * 2, "en")]
    got = [(r.id, [(m.license, m.start) for m in r.matches]) for r in licenses.scan(table(spark, rows)).collect()]
    want = [(1, [("MIT", 2), ("CC-BY-NC-4.0", 7)]), (2, []), (3, []), (4, [("MIT", 3000)]), (5, []), (5, [("MIT", 0)]), (None, [("MIT", 0), ("MIT", 5)])]
    near = [(i, [(n, 3000 if 2995 < s < 3005 else s) for n, s in m]) for i, m in got]
    assert sorted(near, key=str) == sorted(want, key=str)
    assert licenses.scan(table(spark, [])).count() == 0


def _scan(texts, scanner=None):
    scanner = scanner or licenses.Scanner()
    out = [[] for _ in texts]
    for row, t, start, size, share in scanner.scan(*licenses._hashes(pa.array(texts, pa.string()))):
        out[row].append((scanner.names[t], start, size, share))
    return out


def test_licenses_are_told_apart():
    """Relatives differ by a word; cut and stretched notices are found; another version is none of them."""
    t = licenses.TEMPLATES
    for name, texts in t.items():
        for text in texts:
            assert [m[0] for m in _scan([text])[0]] == [name], text
            assert [m[0] for m in _scan(["some words before " + text + " and after it"])[0]] == [name]
    mit, by = t["MIT"][2], t["CC-BY-4.0"][0]
    cut = [by.rsplit(" ", 1)[0], mit.rsplit(" ", 2)[0], mit.split(" ", 3)[3], "x " + by.split(" ", 1)[1]]
    assert [[m[0] for m in found] for found in _scan(cut)] == [["CC-BY-4.0"], ["MIT"], ["MIT"], ["CC-BY-4.0"]]
    stretched = mit.replace("restriction", "restriction one two three four five six seven eight nine ten eleven twelve")
    assert [(m[0], m[2]) for m in _scan([stretched])[0]] == [("MIT", 74)]
    gpl = t["GPL-2.0"][1]
    assert _scan([gpl.replace("version 2", "version 1"), by.replace("4.0", "3.0"), gpl.replace("General", "Local")]) == [[], [], []]
    assert [m[:2] for m in _scan([(by + " ") * 4])[0]] == [("CC-BY-4.0", 13 * i) for i in range(4)]
    assert _scan(["", None, "the", "License"]) == [[]] * 4


def test_license_recall_against_brute_force():
    """Edited notices in random texts: whatever holds enough of a template's shingles and its phrases, counted word by word."""
    rng, scanner = random.Random(1), licenses.Scanner()
    words = [f"w{i}" for i in range(3000)]
    hashes = lambda text: licenses._hashes(pa.array([text]))[0]
    texts, wanted = [], []
    for name, originals in licenses.TEMPLATES.items():
        for original in originals:
            n = len(hashes(original))
            k = 2 if n <= 8 else 3
            own = set(licenses._shingles(hashes(original), k).tolist())
            must = [p for p in (hashes(x).tolist() for x in licenses.PHRASES.get(name, [])) if scanner._has(hashes(original).tolist(), p)]
            for _ in range(12):
                ws = original.split(" ")
                for _ in range(rng.randint(0, max(1, len(ws) // 18))):
                    i, how = rng.randrange(len(ws)), rng.choice("sid")
                    ws[i : i + (how != "i")] = [rng.choice(words)] if how != "d" else []
                left, right = ([rng.choice(words) for _ in range(rng.choice([0, 0, 5, 150]))] for _ in range(2))
                text = " ".join(left + ws + right)
                got = hashes(text)
                limit = n + max(licenses.LEAST_STRETCH, int(n * licenses.STRETCH))
                best = max((len(own & set(licenses._shingles(got[a : a + limit], k).tolist())) for a in range(len(got))), default=0)
                if best >= licenses.CONTAINED * len(own) and all(scanner._has(got.tolist(), p) for p in must):
                    texts.append(text)
                    wanted.append(name)
    found = _scan(texts, scanner)
    # a cut notice may hold as many shingles of a shorter relative
    same = lambda a, b: a == b or a.startswith("BSD") and b.startswith("BSD")
    recall = sum(any(same(m[0], w) for m in f) for f, w in zip(found, wanted)) / len(wanted)
    assert len(wanted) > 250 and recall >= 0.98
    assert all(same(m[0], w) for f, w in zip(found, wanted) for m in f)


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART_BYTES", 300)
    rows = [(i, t, "en") for i, t in [(7, "abc" * 50), (3, None), (5, ""), (9, "x" * 3000 + "y" * 3000), (1, "é🙂" * 40), (9, "second of nine"), (None, "no id at all"), (8, "abc" * 50)]]
    got = fingerprints.against_next(table(spark, rows)).collect()
    ordered = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    by = {(r.id, r.edited_sha256): r for r in got}
    assert len(got) == len(rows)
    for k, (i, t, _) in enumerate(ordered):
        t, n = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = by[i, hashlib.sha256(edited.encode()).hexdigest()]
        a, b, c = fingerprints.fingerprint_texts([t, edited, n])
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(t), a, b)
        assert r.near_edited == fingerprints.likeness(a, b) and r.near_next == fingerprints.likeness(a, c)
    assert fingerprints.against_next(table(spark, [])).count() == 0
    one = fingerprints.against_next(table(spark, [(1, "alone here", "en")])).first()
    assert one.near_next == 1.0 and 0 <= one.near_edited <= 1


def test_walk_against_one_character_at_a_time():
    """The embedding as it is defined: a coin for each step and class of characters says stay or go on."""
    go = lambda c, p: p % fingerprints.PERIOD == fingerprints.PERIOD - 1 or int(fingerprints.mix(np.array([c * fingerprints.PERIOD + p % fingerprints.PERIOD + 0x5EED], np.uint64))[0]) & 1
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdé漢 ", k=n)) for n in (0, 1, 2, 40, 300, 900)] + ["z" * 50]
    kinds = [fingerprints._classes(fingerprints._points(t)) for t in texts]
    for text, kind, steps in zip(texts, kinds, fingerprints.walk(kinds, [0] * len(kinds))):
        at, want = 0, [0]
        for c in kind.tolist():
            while not go(c, at):
                at += 1
            at += 1
            want.append(at)
        assert steps.tolist() == want
        # the sampled symbols are those of the characters that the walk stands on
        level = fingerprints.level_of(len(text))
        copy = [s for s, a, b in zip(fingerprints._symbols(fingerprints._points(text)).tolist(), want, want[1:]) for _ in range(b - a)]
        places = [p for p in fingerprints._steps(level).tolist() if p < len(copy)]
        assert fingerprints.fingerprint_texts([text])[0] == f"{level:02x}" + "".join("%x" % copy[p] for p in places)


@pytest.mark.parametrize("chars,edits", [(60, 1), (400, 1), (400, 5), (3000, 10), (20000, 30)])
def test_recall_of_similar(spark, chars, edits):
    """Of all pairs of likeness 0.8 and more, those that bands bring together, directly or over others."""
    rng = random.Random(chars + edits)
    texts = []
    for _ in range(25):
        base = [rng.choice("abcdefghij klmno") for _ in range(chars)]
        for _ in range(4):
            own = list(base)
            for _ in range(edits):
                i = rng.randrange(len(own))
                own[i : i + rng.choice([0, 1])] = rng.choice(["", "x", "yz"])
            texts.append("".join(own))
    prints = fingerprints.fingerprint_texts(texts)
    links = fingerprints.similar(spark.createDataFrame(list(enumerate(prints)), "id bigint, fingerprint string")).collect()
    root = list(range(len(texts)))
    top = lambda i: i if root[i] == i else top(root[i])
    for r in links:
        root[top(r.a)] = top(r.b)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if fingerprints.likeness(prints[i], prints[j]) >= 0.8]
    found = sum(top(i) == top(j) for i, j in pairs)
    assert not pairs or found >= 0.9 * len(pairs), (found, len(pairs))


def test_walks_and_likeness():
    random.seed(5)
    texts = ["".join(random.choices("abcdefgh ", k=n)) for n in [*range(0, 200, 2), 900, 5000]]
    together = fingerprints.fingerprint_texts(texts)
    assert together == [fingerprints.fingerprint_texts([t])[0] for t in texts]
    near, far = [], []
    for t in texts[-2:]:
        for _ in range(20):
            p = random.randrange(len(t))
            f, g, h = fingerprints.fingerprint_texts([t, t[:p] + t[p + 1 :], "".join(random.sample(t, len(t)))])
            near.append(fingerprints.likeness(f, g))
            far.append(fingerprints.likeness(f, h))
    assert np.mean(near) > 0.6 and max(far) < 0.35 and all(0 <= x <= 1 for x in near + far)
    f, g = fingerprints.fingerprint_texts(["q" * 250 + "abc" * 2, "q" * 250 + "abc" * 3])
    assert f[:2] != g[:2] and fingerprints.likeness(f, g) == fingerprints.likeness(g, f) > 0.5


def test_similar(spark):
    random.seed(6)
    base = "".join(random.choices("abcdefghij ", k=1500))
    rows = [(1, base, ""), (2, base[:700] + "Z" + base[701:], ""), (3, base, ""), (4, "".join(random.sample(base, 1500)), ""), (5, None, ""), (6, "", "")]
    got = {(r.a, r.b) for r in fingerprints.similar(fingerprints.fingerprints(table(spark, rows)), 0.7).collect()}
    assert got == {(1, 3), (1, 2), (5, 6)}


def test_language_id_counts_rare_grams(spark, monkeypatch):
    # n-grams beyond any bound count: the estimates are those of a direct computation over all of them
    monkeypatch.setattr(langid, "GRAMS", 20, raising=False)
    rng = random.Random(6)
    texts = {lang: [" ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(12)) for _ in range(40)] for lang, letters in (("aa", "abcdeé日本"), ("bb", "abxyzß語"))}
    rows = [(i, t, lang) for lang, own in texts.items() for i, t in enumerate(own)]

    def windows(t):
        return [(" " * 4 + w + " ")[i : i + 5] for w in t.split() for i in range(len(w) + 1)]

    def tables(own):
        out = {5: Counter(g for t in own for g in windows(t))}
        for n in (4, 3, 2, 1):
            out[n] = Counter(g[1:] for g in out[n + 1])
        return out

    def prob(g, counts):
        p = 1 / (len(counts[1]) + 1)
        for n in range(1, 6):
            c = counts[n]
            ones, twos = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
            d = ones / (ones + 2 * twos) if ones else 0.5
            own = [x for k, x in c.items() if k[:-1] == g[5 - n : 4]]
            if own:
                p = (max(c[g[5 - n :]] - d, 0) + max(min(d, min(c.values())) * len(own), 1e-6) * p) / sum(own)
        return p

    frame = spark.createDataFrame([(i, lang, t) for i, t, lang in rows], "id bigint, lang string, text string")
    want = {lang: tables(own) for lang, own in texts.items()}
    grams = ["   日本"[-5:], "日本abc"[:5], "    x", "qqqqq", *windows(rows[0][1])[:4], *windows(rows[-1][1])[:4]]
    got = langid.train(frame).log_prob(np.array([[ord(x) for x in g] for g in grams], np.uint32))
    assert np.abs(got - [[np.log(prob(g, want[lang])) for lang in ("aa", "bb")] for g in grams]).max() < 1e-6
    # windows that the workers do not hold are joined, with the same result
    docs = table(spark, [(100 * (lang == "bb") + i, t, lang) for i, t, lang in rows])
    first = sorted(langid.identify(docs).collect(), key=str)
    monkeypatch.setattr(langid, "HEAD", 20)
    assert sorted(langid.identify(docs).collect(), key=str) == first


def test_language_id_limits_cover_all_rows(spark, monkeypatch):
    # most training texts lie outside of the sample for the temperature
    base = [(i, f"the house and the garden number {i} are there with them", "en") for i in range(300)]
    base += [(i, f"das haus und der garten nummer {i} sind nicht weit von uns", "de") for i in range(401, 440)]
    base += [(500, "zxqj vkwx qzzx jjxq wvxq zkqj xxvq qqzj", None)]
    monkeypatch.setattr(langid, "CALIBRATION", 3)
    got = {r.id: r for r in langid.identify(table(spark, base)).collect()}
    monkeypatch.setattr(langid, "CALIBRATION", 4000)
    want = {r.id: r.rejected for r in langid.identify(table(spark, base)).collect()}
    assert {i: r.rejected for i, r in got.items()} == want and got[500].rejected and not got[401].rejected


def test_control_strings_of_other_case():
    """Special tokens match the raw text only."""
    library, coder = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_output._Words(P.path("word_bpe_49k.json"))
    texts = ["<|ENDOFTEXT|>", "<|StartOfText|>", "<|endoftext|>", "a<|EndOfText|>.", "A<|endoftext|>B,", "<|endoftext|><|ENDOFTEXT|>", "<|startoftext|>"]
    stops, ids = coder.encoded(pa.array(texts), b"")
    for t, a, b in zip(texts, stops[:-1].tolist(), stops[1:].tolist()):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [3, 500])
def test_similar_in_hot_bands(spark, monkeypatch, block):
    # smaller ids that are not similar sit in every band of the similar ones
    monkeypatch.setattr(fingerprints, "GROUP", block, raising=False)
    rng = random.Random(8)
    some = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    prints, at = {}, 0
    for _ in range(3):
        base = some(64)
        for a in (0, 16, 32):
            prints[at := at + 1] = "01" + some(a) + base[a : a + 32] + some(32 - a)
        for _ in range(6):
            p = rng.randrange(64)
            prints[at := at + 1] = "01" + base[:p] + "x" + base[p + 1 :]

    def tied(pairs):
        root = {i: i for i in prints}
        for a, b in pairs:
            old, new = root[b], root[a]
            root = {i: new if r == old else r for i, r in root.items()}
        return {frozenset(i for i in root if root[i] == r) for r in root.values()}

    want = {(a, b) for a in prints for b in prints if a < b and fingerprints.likeness(prints[a], prints[b]) >= 0.8}
    got = fingerprints.similar(spark.createDataFrame(list(prints.items()), "id bigint, fingerprint string")).collect()
    assert {(r.a, r.b) for r in got} <= want and tied([(r.a, r.b) for r in got]) == tied(want) and len(tied(want)) == 12
    assert all(r.likeness == fingerprints.likeness(prints[r.a], prints[r.b]) for r in got)

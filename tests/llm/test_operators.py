"""Each training-data operator against brute force, an exact round trip or the library it must equal."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marklane.llm import ann, ans, bpe, chat, classifier, html, minhash, mixing, mpeg, sharding
from marklane.llm.entry import QUERIES, SHARDS, SLOTS, tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, ids string, score string"
HARD = [None, "", " ", "a", "A a  b\n\nc ", "x" * 30_000, "y z " * 9_000, "<|endoftext|> é 日本 😀", "it's  we'll\t.", "\x00\x01 q", " a\x85b\x1c"]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and long texts, repeated rows and ids, columns that clash with results."""
    rows = [(i, t, None if i % 3 else "s", "clash", "clash") for i, t in enumerate(HARD)]
    return spark.createDataFrame([*rows, rows[3], (None, "text without an id", "s", "c", "c"), (4, "another text of id 4", None, "c", "c")], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_library(spark, hard, empty):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = bpe.decode(bpe.encode(hard, path), path).collect()
    assert len(rows) == hard.count()
    once = bpe.round_trip(hard, path).collect()
    assert sorted((r["ids"], r["decoded"], r["source"] or "") for r in once) == sorted((r["ids"], r["decoded"], r["source"] or "") for r in rows) and all(r["exact"] for r in once)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == tok.decode(ids, skip_special_tokens=False) == (r["text"] or "")
    assert bpe.decode(bpe.encode(empty, path), path).count() == 0


def test_bpe_merges_runs_from_the_left():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    model, tok = bpe.NumpyBPE(path), Tokenizer.from_file(path)
    for t in ["aaaaa", "aaaa aaa", "ababab", "!!!!!!!", "1111111111", "ééééé", "\n \n a", "a \nb  c"]:
        assert model.encode([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_query_op3(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op3_bpe_merge_rounds"](spark, SF).collect():
        ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_rans_blocks_round_trip():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 1000, 500) ** 2
    counts[7] = 10**12
    coder = ans.Coder(ans.scaled(counts))
    assert int(coder.freq.sum()) == 1 << ans.SCALE_BITS and coder.freq.min() >= 1
    docs = [(1, np.zeros(0, np.uint32)), (None, rng.integers(0, 500, 5).astype(np.uint32)), (-3, rng.integers(0, 500, ans.BLOCK_IDS + 11).astype(np.uint32)), (9, np.full(70_000, 7, np.uint32))]
    image = ans.write_file(coder, docs)
    for (i, x), (j, y) in zip(docs, ans.read_file(coder, image), strict=True):
        assert i == j and (x == y).all()
    whole = np.concatenate([x for _, x in docs])
    for k in (1, 0):
        first, block = ans.read_block(coder, image, k)
        assert (block == whole[first : first + len(block)]).all() and len(block)
    with pytest.raises(ValueError, match="another frequency table"):
        ans.read_block(ans.Coder(ans.scaled(counts[::-1])), image, 0)
    damaged = bytearray(image)
    damaged[-3] ^= 1
    with pytest.raises(ValueError):
        list(ans.read_file(coder, bytes(damaged)))


def test_rans_files(spark, hard, empty):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = ans.read_corpus(spark, ans.write_corpus(hard, path, 1, 49_408)).orderBy("start").collect()
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in hard.collect()), key=lambda x: (x[0], x[1], len(x[2])))
    start = 0
    for (known, i, ids), r in zip(want, rows, strict=True):
        assert (r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"]) == (known, i, start, len(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        start += len(ids)
    assert ans.read_corpus(spark, ans.write_corpus(empty, path, 1, 49_408)).count() == 0
    with pytest.raises(Exception, match="outside of the vocabulary"):
        ans.write_corpus(hard, path, 1, 300)


def test_query_op6(spark):
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), 0
    rows = {r["doc_id"]: r for r in QUERIES["op6_rans_files"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids, r = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 1], rows[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_library_pieces_equal_whole_texts(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    tok, cache = Tokenizer.from_file(path), ans.library_ids(path)
    texts = [t for t in HARD if t] + ["ΑΣ. ΑΣ, İ.", "e ́", "word.. word., 'tis. <|startoftext|>.", "q \x01 \x01."] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    marks = [chr(c) for c in range(1, 0x300)]
    texts += [" ".join(a + b for a in marks for b in ("", "a", ".", "'s", " ")), "don't 'S !'re x1y22 user@site.org <|ENDOFTEXT|> <| |> ŒUVRE, ß. ﬁ ǅ ʹ"]
    for t in texts:
        assert cache.ids([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids
    flat, ends = cache.ids_of(pa.array([None, *texts, ""]))
    assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [[], *(tok.encode(t, add_special_tokens=False).ids for t in texts), []]


def test_library_pieces_refuse_other_rules():
    with pytest.raises(ValueError):
        ans.library_ids(tokenizer("byte_bpe_50k.json"))


def test_multi_index_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    bad = [(10_000, None), (10_020, [0.0] * 64), (10_040, [float("nan")] * 64), (10_060, [None] * 64), (10_080, [float("inf")] * 64), (10_100, []), (10_120, [1.0])]
    data = [*rows, *bad, (20_001, rows[0][1]), (20_000, [3 * x for x in rows[0][1]]), (None, rows[1][1])]
    vectors = spark.createDataFrame([(i, v, "clash") for i, v in data], "vec_id long, v array<float>, score string")
    found = ann.search(vectors, F.col("vec_id") % 20 == 0).collect()
    known = [(i, np.array(v, np.float32).astype(float)) for i, v in [*rows, *data[-3:-1]]]
    ids, x = np.array([i for i, _ in known]), np.stack([v for _, v in known])
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        s = x @ x[ids == q][0]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        assert [r["rank"] for r in mine] == list(range(1, len(order) + 1))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        for r in mine:
            assert abs(r["score"] - s[ids == r["vec_id"]][0]) < 1e-12
        hits, total = hits + len({ids[j] for j in order} & {r["vec_id"] for r in mine}), total + len(order)
    assert hits >= 0.9 * total
    assert ann.search(vectors.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_multi_index_recall_on_separate_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 16))).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<float>")
    found = ann.search(vectors, F.col("vec_id") % 300 == 0, entries=1500).collect()
    exact = x.astype(float)
    hits = 0
    for q in range(0, 6000, 300):
        s = exact @ exact[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hits >= 0.9 * 400


def test_multi_index_recall_above_the_budget(spark):
    """Vectors without clusters in a table of four times ``entries``, and a hot cell of equal vectors."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(16_000, 64)).astype(np.float32)
    x[:2_000] = x[0]
    x = x[rng.permutation(len(x))]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<float>")
    found: dict = {}
    for r in ann.search(vectors, F.col("vec_id") % 200 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    exact = x.astype(float)
    hits = total = 0
    for q in range(0, len(x), 200):
        s = exact @ exact[q]
        s[q] = -np.inf
        bar = np.sort(s)[-20]
        hits, total = hits + sum(s[v] >= bar - 1e-9 for v in found[q]), total + 20
    assert hits >= 0.9 * total, hits / total


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">Home page of this site</a></li></ul></nav><header><p>The name of the site and what it is for.</p></header>
<div class="cookie-notice">We use cookies and that is what you have to know.</div>
<article><h1>Title &amp; more</h1><p><b>First   line&nbsp;of the text.<br><p>Second &lt;b&gt; caf&#233; and it is the one that was here.</p><p>Short.</p><div class="ad">Buy the thing now</div>
<!-- hidden <p>x</p> --><p>Third of the lines with <a href="/x">a link</a> in it and more of the words.</p><form>Mail: <input></form></article>
<aside>Something else that is not of the article</aside><div id="comments"><p>I think that it is the best of all the pages I have seen.</p></div><footer>&copy; the owner</footer>"""


def test_html_main_text(spark):
    want = "Title & more\nFirst line of the text.\nSecond <b> café and it is the one that was here.\nShort.\nThird of the lines with a link in it and more of the words."
    assert html.main_text(PAGE) == want
    rows = spark.createDataFrame([(1, PAGE, "c"), (2, None, "c"), (3, "", "c"), (3, "<p", "c"), (4, "<div>" * 3000 + "x", "c")], "page_id long, html string, text string")
    got = html.extract(rows).collect()
    assert [r["text"] for r in got][:3] == [want, "", ""] and len(got) == 5
    assert html.extract(rows.where("false")).count() == 0


def test_html_without_article_element():
    good = "The house of the old man is on the hill and that is what he had for all of his life. " * 4
    page = f"<body><div class='menu'><a href='/'>x</a></div><div>{good}</div><div>And so it was.</div><div>{good}</div><ul><li><a href='/1'>one link here</a></li><li><a href='/2'>other link</a></li></ul><div>Contact us</div></body>"
    assert html.main_text(page) == f"{good.strip()}\nAnd so it was.\n{good.strip()}"


def test_html_articles_of_the_pages(spark):
    """Brute force on the table's own layout: what stands between the article tags, block by block."""
    import html as h
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        assert html.main_text(r["html"]) == "\n".join(b for b in want if b)


def test_mpeg_round_trip(spark, hard, empty):
    for n in (1, 192, 936, 937, 938, 1874, 100_000):
        payload = bytes(range(256)) * (n // 256 + 1)
        back, s = mpeg.read_payload(mpeg.write_stream(payload[:n]))
        assert back == payload[:n] and s.bad == 0 and s.skipped == 0 and s.samples == 1152 * len(s.offsets)
    rows = mpeg.restore(mpeg.store_text(hard)).collect()
    for r in rows:
        raw = (r["text"] or "").encode()
        assert r["n_bytes"] == len(raw) and len(r["payload"]) % 192 == 0 and len(r["payload"]) >= 192
        assert r["payload"] == raw.ljust(len(r["payload"]), b" ")
    assert mpeg.restore(mpeg.store_text(empty)).count() == 0


def test_mpeg_damage_and_tags(spark):
    good = mpeg.write_stream(b"q" * 5000)
    whole = mpeg.read_stream(good)
    first = whole.offsets[1]
    noisy = good[:first] + b"\xff\xfbnoise\x00" + good[first:] + b"TAG" + b"Title".ljust(125, b"\0")
    s = mpeg.read_stream(noisy)
    assert len(s.offsets) == len(whole.offsets) and s.skipped == 8 and s.tags["v1:title"] == "Title"
    assert s.table == "Xing" and s.table_frames == len(whole.offsets) and s.toc[0] < s.toc[99]
    broken = bytearray(good)
    broken[first + 10] ^= 255  # side information, which the checksum protects
    assert mpeg.read_stream(bytes(broken)).bad == 1
    with pytest.raises(ValueError):
        mpeg.read_payload(bytes(broken))
    rows = spark.createDataFrame([(1, bytearray(good), "c"), (2, None, "c"), (3, bytearray(b""), "c"), (4, bytearray(b"no audio" * 99), "c")], "id long, content binary, toc string")
    got = mpeg.parse_column(rows).orderBy("id").collect()
    assert [r["n_frames"] for r in got] == [len(whole.offsets), 0, 0, 0] and got[0]["sample_rate"] == 48_000 and got[1]["sample_rate"] is None


def test_query_op4(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op4_mpeg_audio"](spark, SF).collect():
        raw = texts[r["doc_id"]].encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-16:])


def test_classifier_held_out(spark, hard, empty):
    rows = QUERIES["op5_attention_mil"](spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert len(held) > 50 and sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.97 * len(held)
    known = spark.createDataFrame([(i, i % 2) for i in range(len(HARD))] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = classifier.train(hard, known)
    scores = [r["score"] for r in classifier.score(hard, model).collect()]
    assert len(scores) == hard.count() and all(0 <= s <= 1 for s in scores)
    assert classifier.score(empty, classifier.train(empty, known.where("false"))).count() == 0


def test_scores_against_a_plain_forward_pass(spark, hard):
    """Every score of the query's operator, passage by passage in plain Python."""
    import math

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = classifier.train(docs, labels)
    p, tanh = {k: v.tolist() for k, v in model.p.items()}, math.tanh
    rows = [*docs.limit(30).select("text").collect(), *hard.select("text").collect()]
    for r, got in zip(rows, classifier.score(docs.limit(30).select("text").union(hard.select("text")), model).collect(), strict=True):
        hidden, weights = [], []
        for x in classifier.encode(r["text"]):
            z = [(a - m) / s for a, m, s in zip(x.tolist(), model.mean.tolist(), model.sd.tolist(), strict=True)]
            h = [tanh(sum(a * w[j] for a, w in zip(z, p["W"], strict=True)) + p["b"][j]) for j in range(len(p["b"]))]
            gate = [tanh(sum(a * v[j] for a, v in zip(h, p["V"], strict=True))) / (1 + math.exp(-sum(a * u[j] for a, u in zip(h, p["U"], strict=True)))) for j in range(len(p["w"]))]
            hidden.append(h), weights.append(sum(a * b for a, b in zip(gate, p["w"], strict=True)))
        e = [math.exp(w - max(weights)) for w in weights]
        bag = [sum(a * h[j] for a, h in zip(e, hidden, strict=True)) / sum(e) for j in range(len(hidden[0]))]
        assert abs(1 / (1 + math.exp(-sum(a * c for a, c in zip(bag, p["c"], strict=True)) - p["d"][0])) - got["score"]) < 1e-6


def test_trigrams_of_a_passage():
    text = "Abc def abc " * 120
    parts = classifier.passages(text.encode())
    assert b"".join(parts) == text.encode() and len(parts) > 1
    for part, row in zip(parts, classifier.encode(text), strict=True):
        low, counts = part.lower(), np.zeros(classifier.GRAMS)
        for i in range(len(low) - 2):
            counts[(int.from_bytes(low[i : i + 3], "big") * 0x9E3779B1 % 2**32) >> 26] += 1
        assert np.allclose(row[-classifier.GRAMS :] ** 2, counts / (len(low) - 2), atol=1e-6)


def test_training_sample_is_bounded_by_whole_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word text " * 400, ) for i in range(20)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(classifier, "fit", lambda x, starts, y, seed=7: seen.append((len(x), len(starts))))
    per = len(classifier.encode("word text " * 400))
    classifier.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"), rows=3 * per + 1)
    assert seen == [(4 * per, 4)]


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(5)
    bags = [rng.normal(size=(6, classifier.N_FEATURES)) for _ in range(400)]
    y = np.arange(400) % 2
    for b, label in zip(bags, y, strict=True):
        b[rng.integers(0, 6), 0] = 8 if label else -8
    starts = np.arange(400) * 6
    model = classifier.fit(np.concatenate(bags), starts, y.astype(float))
    out = model.bags(np.concatenate(bags), starts)
    assert ((out["score"] > 0.5) == y).mean() > 0.97


def test_sharding(spark, hard, empty):
    table = np.array(sharding.lookup(SHARDS, SLOTS))
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = np.array(sharding.lookup(SHARDS[:-1], SLOTS))
    stay = table < len(SHARDS) - 1
    assert (fewer[stay] == table[stay]).mean() > 0.75
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup(bad, 7)
    with pytest.raises(ValueError):
        sharding.lookup(["a"], 9)
    rows = sharding.assign(hard.withColumnRenamed("score", "shard"), "doc_id", SHARDS, SLOTS).collect()
    assert len(rows) == hard.count()
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % SLOTS
        assert r["slot"] == slot and r["shard"] == SHARDS[table[slot]]
    assert sharding.assign(empty, "doc_id", SHARDS, SLOTS).count() == 0


def test_chat_round_trip(spark):
    texts = ["", "plain", "</s>[INST] ok [/INST]", r"<\/s> [\INST] \\", "[INST", "</s", " [/INST]", "[TURN 61] x [/TURN]", "[OUT] ", r"<\\s>", "<s>", "[" * 50, "a\n\n b "]
    for role in ["user", "assistant", "system", None, "", "tool 7", "é"]:
        for t in texts:
            (turn,) = chat.parse(chat.render(role, t))
            assert chat.unescape(turn.text) == t and turn.role == role
            assert chat.unescape(chat.escape(t)) == t
    whole = "".join(chat.render(r, t) for r in ("user", "assistant") for t in texts)
    assert [chat.unescape(t.text) for t in chat.parse(whole)] == texts * 2
    with pytest.raises(ValueError):
        chat.parse("stray")
    rows = spark.createDataFrame([(1, 0, "user", "q", "c"), (1, 1, "assistant", None, "c"), (1, 1, "assistant", "é</s>", "c"), (None, None, None, None, "c")], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(rows)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 5 and got[1]["loss_sha256"] == hashlib.sha256("é</s>".encode()).hexdigest()
    assert got[None]["n_turns"] == 1
    assert chat.digest(chat.format_turns(rows.where("false"))).count() == 0


def plain_targets(sizes: list, weights=(5, 2, 1), share=1.5, limit=2.0) -> dict:
    """Targets round by round: sources above their limit are filled and the rest is shared again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    size, open_, out = dict(sizes), {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}, {}
    left = share * sum(size.values())
    while open_:
        total = sum(open_.values())
        full = [s for s in open_ if left * open_[s] / total > limit * size[s]]
        if not full:
            return out | {s: left * w / total for s, w in open_.items()}
        for s in full:
            out[s] = limit * size[s]
            del open_[s]
        left -= sum(out[s] for s in full)
    return out


def test_targets(spark):
    for sizes in ([("b", 100), ("a", 10), ("c", 1000), (None, 0)], [("x", 5)], [("a", 1), ("é", 1), ("z", 90), ("𝒳", 7), (None, 3)], []):
        got = {r["source"]: r for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s]["target"] - want[s]) < 1e-9 for s in want)
        names = sorted(want, key=lambda s: (s is None, s or ""))
        assert [got[s]["slope"] for s in names] == sorted(got[s]["slope"] for s in names)


def test_mixing(spark, hard, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    by: dict = {}
    for r in rows:
        m = r["mix"]
        assert m["taken"] == m["size"] * len(m["positions"]) and len(m["positions"]) <= 2 and all(0 <= p <= 1 for p in m["positions"])
        by.setdefault(r["source"], [m["target"], 0, 0])
        by[r["source"]][1] += m["taken"]
        by[r["source"]][2] = max(by[r["source"]][2], m["size"])
    assert all(abs(t - n) <= most / 2 for t, n, most in by.values())
    assert sorted((r["doc_id"], r["mix"]["taken"]) for r in mixing.mix(docs.repartition(7), rows_per_bucket=3, carry=False).collect()) == sorted((r["doc_id"], r["mix"]["taken"]) for r in rows)
    copies = mixing.schedule(mixed).collect()
    assert [r["mix"]["position"] for r in copies] == sorted(r["mix"]["position"] for r in copies) and sum(r["mix"]["size"] for r in copies) == sum(r["mix"]["taken"] for r in rows)
    names = {"ids": "copy", "score": "position"}
    clash = hard.withColumnsRenamed(names).withColumns({c: F.lit("mine") for c in ("size", "target", "taken", "s", "b", "r", "d", "k", "h", "ahead", "before", "fill", "mix")})
    odd = mixing.mix(clash, rows_per_bucket=2).collect()
    assert len(odd) == hard.count() and sum(r["mix"]["size"] for r in odd) == sum(len((t or "").encode().split()) for t in [*HARD, HARD[3], "text without an id", "another text of id 4"])
    back = mixing.schedule(mixing.mix(clash)).collect()
    assert back and all(r["taken"] == r["size"] == r["s"] == "mine" and r["copy"] == r["position"] and r["copy"] in ("clash", "c") for r in [*odd, *back])
    assert mixing.mix(empty).count() == 0 and mixing.schedule(mixing.mix(empty)).count() == 0


def test_schedule_inverts_its_integral(spark):
    for slope in (-0.8, 0.0, 0.5):
        for share in (0.0, 0.1, 0.5, 1.0):
            t = spark.range(1).select(mixing.position(F.lit(share), F.lit(slope))).first()[0]
            assert abs((1 - slope) * t + slope * t * t - share) < 1e-9


def _brute(rows: list, percent: int = 75) -> dict:
    sets = [(i, set(minhash.shingles(t).tolist())) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def test_near_duplicates_against_brute_force(spark, hard, empty):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 120)]
    rows = [(100 + i, " ".join(base[:i] + ["NEW" + str(i)] + base[i + 1 :])) for i in range(0, 120, 2)]  # copies of one text that nothing else links
    chain = [(500 + i, " ".join(f"c{j}" for j in range(8 * i, 8 * i + 100))) for i in range(12)]
    rows += chain + [(900, "one two"), (901, "ONE  two"), (902, None), (903, ""), (904, "one two three"), (905, " \t "), (99, " ".join(base))]
    rows += [(r["doc_id"] + 10_000, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = _brute(rows)
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fp string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    assert all(r["n_shingles"] == len(minhash.shingles(dict(rows)[r["doc_id"]])) for r in got)
    odd = minhash.near_duplicates(hard, carry=("score",)).collect()
    assert len(odd) == hard.count() and all(r["score"] in ("clash", "c") for r in odd)
    assert len({r["group_id"] for r in odd if r["doc_id"] == 4}) == 2  # unlike texts under one doc_id
    assert minhash.near_duplicates(empty).count() == 0


def test_estimate_is_near_the_similarity(spark):
    words = [f"v{i}" for i in range(1000)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:900]))], "doc_id long, text string")
    a, b = minhash.signature(rows).orderBy("doc_id").select("sig").collect()
    est = spark.createDataFrame([(a[0], b[0])], "a array<long>, b array<long>").select(minhash.similarity(F.col("a"), F.col("b"))).first()[0]
    assert abs(est - 896 / 996) < 0.12


def test_open_pairs_of_short_texts_at_the_threshold(spark, monkeypatch):
    """Sets of 6 to 40 shingles whose similarity is exactly 0.75 stay above the bar of the estimate."""
    rng = np.random.default_rng(7)
    sets, split = [], []
    for both, union in ((6, 8), (9, 12), (12, 16), (24, 32), (30, 40)):
        for _ in range(60):
            u = rng.integers(0, 1 << 63, union).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, union).astype(np.uint64)
            one = both + (union - both) // 2
            for s in (u[:one], np.r_[u[:both], u[one:]]):
                split.append((len(sets), len(sets) // 2, len(sets)))
                sets.append((len(sets), bytearray(np.sort(s).tobytes())))
    wide = minhash._wide(spark.createDataFrame(sets, "id long, s binary")).drop("s")
    pairs = minhash._open_pairs(spark.createDataFrame(split, "id long, h long, c long"), wide, 0.75 - minhash.WIDE_SLACK)
    assert pairs.count() == len(sets) // 2
    monkeypatch.setattr(minhash, "BLOCK", 7)  # one bucket for all, in many blocks: still every pair once
    one = spark.createDataFrame([(i, 0, i) for i in range(60)], "id long, h long, c long")
    assert sorted(minhash._open_pairs(one, wide, -1.0).collect()) == [(i, j) for i in range(60) for j in range(i + 1, 60)]


def test_query_op9_takes_what_the_schedule_gives(spark, monkeypatch):
    made, whole = [], mixing.schedule

    def kept(mixed):
        made.append(whole(mixed))
        return made[-1]

    monkeypatch.setattr(mixing, "schedule", kept)
    rows = QUERIES["op9_curriculum_mix"](spark, SF).collect()
    copies = made[0].collect()
    spots = [(r["mix"]["position"], r["doc_id"], r["mix"]["copy"]) for r in copies]
    assert spots == sorted(spots) and len({r["mix"]["copy"] for r in copies}) == 2
    want = {(r["doc_id"], r["mix"]["taken"]) for r in mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "mix").collect()}
    assert {(r["doc_id"], r["taken"]) for r in rows} == want and sum(r["mix"]["size"] for r in copies) == sum(r["taken"] for r in rows)
    monkeypatch.setattr(mixing, "schedule", lambda mixed: whole(mixed).where("mix.copy = 0"))
    assert all(r["taken"] <= r["size"] for r in QUERIES["op9_curriculum_mix"](spark, SF).collect())


def test_mpeg_payload_like_a_closing_tag():
    for n in (937, 5000, 100_000):
        payload = b"TAG" * (n // 3 + 1)
        for shift in range(3):
            text = payload[shift : shift + n]
            back, s = mpeg.read_payload(mpeg.write_stream(text))
            assert back == text and s.skipped == 0


def test_html_marks_weigh():
    good = ("The house of the old man is on the hill and that is what he had for all of his life. " * 4).strip()
    card = "<article><h2>Other</h2><p>A card of another page that is short.</p></article>"
    assert good in html.main_text(f"<body><div>{good}</div><div>{good}</div>{card}</body>")
    assert html.main_text(f'<div class="layout has-sidebar"><article><p>{good}</p></article><div class="sidebar">{good}</div></div>') == good
    assert html.main_text(f'<div class="layout has-sidebar"><div><p>{good}</p><p>{good}</p></div><div class="sidebar">And more</div></div>') == f"{good}\n{good}"
    assert html.main_text(f"<article><p>{good}</p><p>{good}</p></article><div>{good}</div><div>Short and of no use.</div>") == f"{good}\n{good}\n{good}"
    assert html.main_text(f'<article><p>{good}</p><p>{good}</p></article><div id="comments">{good}</div><aside><article>{good}</article></aside>') == f"{good}\n{good}"


def test_html_wrappers_keep_their_article():
    good = ("The house of the old man is on the hill and that is what he had for all of his life. " * 4).strip()
    for name in ("layout has-sidebar", "page no-sidebar", "content with-nav", "site share-enabled", "post related-work"):
        for inner in (f"<article><p>{good}</p></article>", f"<div><p>{good}</p><p>{good}</p></div>"):
            assert good in html.main_text(f'<body><nav><a href="/">Home</a></nav><div class="{name}">{inner}</div></body>'), name
    assert html.main_text(f'<article><p>{good}</p><section id="notice-periods"><p>{good}</p></section></article>') == f"{good}\n{good}"
    assert html.main_text(f'<form action="/x"><div><p>{good}</p><p>{good}</p><input></div></form>') == f"{good}\n{good}"
    for name in ("cookie-notice", "ad-box", "ad_300x250", "shareButtons", "related-posts", "sidebar-left"):
        assert html.main_text(f'<article><p>{good}</p></article><div class="{name}"><p>{good}</p></div>') == good, name
    assert html.main_text(f'<article><p>{good}</p></article><ol class="commentlist"><li><article class="comment-body"><p>{good} {good}</p></article></li></ol>') == good


def test_html_without_the_article_tags(spark):
    """The two passes alone give nearly all pages of the table their text; pages in a language without a list too."""
    import re

    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    same = [html.main_text(p) == html.main_text(re.sub("</?article>", "", p)) for p in pages]
    assert sum(same) >= 0.95 * len(same)
    foreign = "Talo seisoo kukkulalla, ja vanha mies asui siellä koko elämänsä. Hän ei koskaan lähtenyt kylästään. " * 3
    page = f'<body><ul><li><a href="/a">Etusivu</a></li></ul><div>{foreign}</div><div>Niin se oli.</div><div>{foreign}</div><ul><li><a href="/b">Lisää</a></li></ul></body>'
    assert html.main_text(page) == f"{foreign.strip()}\nNiin se oli.\n{foreign.strip()}"


def test_html_scans_in_linear_time():
    import time

    for bad in ("<a " * 300_000, '<a ">" ' * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<div class=ad>" * 30_000, "<span>" * 30_000 + "<p></p>" * 30_000, "<!-- " * 100_000, "&#" + "9" * 50_000 + ";"):
        began = time.time()
        html.main_text(bad)
        assert time.time() - began < 10
    long = "<article>" + "<p>It is one of the lines that are in the text for all.</p>" * 20_000 + "</article>"
    assert html.main_text(long).count("\n") == 19_999


def test_commonest_width_is_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(1000 + i, rng.normal(size=9).tolist()) for i in range(3)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, v array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert {r["query_id"] for r in found} == {0, 20, 40} and max(r["vec_id"] for r in found) < 60 and len(found) == 60


def test_groups_of_cells_against_all_entries(spark, monkeypatch):
    """Small groups and blocks, a hot cell of many groups, ties: with all cells visited the result is exact."""
    monkeypatch.setattr(ann, "GROUP", 50)
    monkeypatch.setattr(ann, "ASKED", 3)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    x[:400] = x[0]
    found: dict = {}
    for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<float>"), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    exact = x.astype(float)
    for q in range(0, 900, 20):
        s = (exact * exact[q]).sum(axis=1)
        s[q] = -np.inf
        assert [v for _, v in sorted(found[q])] == np.lexsort((np.arange(900), -s))[:20].tolist()


def test_words_of_pieces_are_encoded_once():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from marklane.llm import ans

    path = tokenizer("word_bpe_49k.json")
    ans._TOKENIZERS.clear()
    cache = ans.library_ids(path)
    texts = ["Stone stone, STONE. stone's", "stone\nStone\n\n stones", None, "", "\n", "x\r\ny \u00e9t\u00e9\n<|endoftext|>\n1\x0b2"]
    flat, ends = cache.ids_of(pa.array(texts))
    tok = Tokenizer.from_file(path)
    assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [w for w in cache.words.index if "stone" in w] == ["stone", "stones"]

"""The filter audit, spelling variants and URL filters against brute force, and their edge cases."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from marklane.llm import audit, spelling, urls
from marklane.llm.entry import QUERIES, RULES

DOC = "doc_id long, text string, source string"
LABEL = "doc_id long, quality int, toxic int"


def _fails(doc, docs):
    i, text = doc[0], doc[1] or ""
    words = re.findall(audit.WORD, text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        out.add("C")
    if re.search("[#$%&*|]", text):
        out.add("D")
    if i is not None and any(o[0] is not None and o[0] < i and (o[1] or "") == text for o in docs):
        out.add("E")
    return out


def _audited(docs, labels):
    """Every order run as it is written, one filter after the other."""
    good, toxic = ({d for d, q, t in labels if d is not None and (q if k == 0 else t) == 1} for k in (0, 1))
    failed = [(d, _fails(d, docs)) for d in docs]
    out = {}
    for part in {d[2] or "" for d in docs}:
        here = [(d, f) for d, f in failed if (d[2] or "") == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = here
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                kept = [x for x in left if letter not in x[1]]
                fails = [x for x in here if letter in x[1]]
                removed_by[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), len(fails) - len(gone), sum(f == {letter} for _, f in here),
                    sum(d[0] in good for d, _ in gone), sum(d[0] in toxic for d, _ in gone), letter,
                ]
                left = kept
        for key, row in out.items():
            if key[0] == part:
                row[-1] = removed_by[key[1][key[2] - 1]]
    return {k: tuple(v) for k, v in out.items()}


def _long(i, n=60):
    return " ".join(f"w{i}x{k}" for k in range(n))


DOCS = [
    (1, _long(1), "a"), (2, _long(1), "b"), (3, _long(1), None), (3, _long(1), "a"), (4, None, "a"), (5, "", "a"), (6, "", None), (7, "Same same " * 40, "b"),
    (8, "# " + _long(8), "a"), (9, _long(9).upper(), "b"), (10, _long(9).upper(), "b"), (None, _long(1), "a"), (None, None, None), (11, "| A B", "b"), (12, _long(12, 49), ""), (13, _long(13) * 3000, "a"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 1), (3, 1, 0), (7, 0, 1), (9, None, 1), (None, 1, 1), (99, 1, 1), (11, 0, 0)]


def test_audit_equals_all_orders(spark):
    docs = spark.createDataFrame([(*d, "x", 5) for d in DOCS], DOC + ", mask string, part int")
    got = audit.audit(docs, spark.createDataFrame(LABELS, LABEL))
    assert {tuple(r[:3]): tuple(r[3:]) for r in got.collect()} == _audited(DOCS, LABELS)
    assert got.count() == 600 * len({d[2] or "" for d in DOCS})


def test_audit_of_nothing_and_without_labels(spark):
    none = spark.createDataFrame([], LABEL)
    assert audit.audit(spark.createDataFrame([], DOC), none).count() == 0
    docs = spark.createDataFrame(DOCS, DOC)
    assert {(r["good_lost"], r["toxic_lost"]) for r in audit.audit(docs, none).collect()} == {(0, 0)}


def test_removal_polynomial_and_shapley_of_three_filters(spark):
    counts = spark.createDataFrame([("p", 0, 4, 0, 0), ("p", 1, 3, 1, 0), ("p", 3, 2, 0, 1), ("p", 7, 6, 0, 0)], "part string, mask int, n long, good long, toxic long")
    row = audit.polynomials(counts, 3).select("p_n", audit.corners("p_n", 3).alias("v"), audit.shapley("p_n", 3).alias("s")).first()
    assert row["v"] == [0, 11, 8, 11, 6, 11, 8, 11]
    assert row["s"] == [6 * 3 + 6 * 2 // 2 + 6 * 6 // 3, 6 * 2 // 2 + 6 * 6 // 3, 6 * 6 // 3]
    assert row["p_n"][1] == 11 and row["p_n"][3] == -8 and row["p_n"][7] == 6
    with pytest.raises(ValueError):
        audit.report(counts, "AAB")


def _counted(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def _distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(words):
    near = {w: [(-n, v) for v, n in words.items() if _distance_one(w, v)] for w in words}
    form = {w: min(x)[1] if x and -min(x)[0] >= 10 * words[w] else None for w, x in near.items()}
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def _misspelled(seed, n):
    rng = np.random.default_rng(seed)
    base = ["annotate", "aaaaaaab", "Übergröße", "letterings", "straßenbahn", "banananas", "mississippi"]
    letters = "abeißüÿ\u00d7"
    docs = []
    for i in range(n):
        text = []
        for _ in range(60):
            w = base[int(len(base) * rng.random() ** 2)]
            if rng.random() < 0.2:
                k, c = rng.integers(len(w)), letters[rng.integers(len(letters))]
                w = [w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]][rng.integers(3)]
            text.append(w)
        docs.append((i, " ".join(text)))
    return docs


def test_variants_equal_brute_force(spark):
    docs = [*_misspelled(1, 120), (None, "annotated annotated Annotated"), (500, None), (501, ""), (502, "12 34 _ ☃"), (503, "lettering " * 5000), (504, "harbours " * 3000 + "harbourss " * 120 + "harboursss " * 5), (7, "annotates"), (7, "annotates")]
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(rows).collect()}
    want = _variants(_counted(docs))
    assert got == want
    assert any(f != r and f for f, r, *_ in want.values()), "no chain of forms in the fixture"


def test_variants_with_a_full_filter_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LEAST_BITS", 7)
    monkeypatch.setattr(spelling, "MOST_BITS", 7)  # nearly every bit is set: candidates are kept, the join decides
    docs = _misspelled(2, 20)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == _variants(_counted(docs))


def test_neighbourhood_is_whole_and_distinct(spark):
    words = ["aaaa", "abab", "bccb"]
    letters = sorted(map(ord, "abc"))
    every = np.full(1 << 15, 0xFFFFFFFF, np.uint32)
    got = spelling.candidates(spark.createDataFrame([(w,) for w in words], "word string"), letters, 4, every, 20).collect()
    for w in words:
        found = [r["near"] for r in got if r["word"] == w]
        want = {w[:i] + w[i + 1 :] for i in range(4)} | {w[:i] + c + w[i + 1 :] for i in range(4) for c in "abc"} - {w} | {w[:i] + c + w[i:] for i in range(5) for c in "abc"}
        assert sorted(found) == sorted(want)


def test_variants_without_words(spark):
    for docs in ([], [(1, None)], [(1, "short words only")]):
        assert spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect() == []


def test_words_without_neighbours_have_no_form(spark):
    docs = [(i, "solitary") for i in range(3)]
    words = _counted(docs)
    got = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [("solitary", None, "solitary", words["solitary"], 0, None)]


URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.NET/en/x", "http://example.net/de/", "http://a.example.net/en/1", "http://badexample.net/en/1", "http://net", "http://net/", "http://x.net?y=/",
    "https://shop.example.com/de/1#x", "https://example.com/de", "ftp://a.org/fr/", "ftp://a.org/FR/", "x://y.org/en/?u=http://z.net/", "http://list.ed/a/", "http://www.LIST.ed/a?utm_x=1&ref=2#f",
    "http://list.ed/a?b=2&a=1", "http://list.ed/a?a=1&b=2", "http://list.ed/A", "http://list.ed/b", "http://org.fr/fr/", "http://fr.org/fr/\nx",
]


def _judged(url, listed):
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    host, path = re.match(r"[^/?#]*", rest)[0], re.match(r"[^/?#]*([^?#]*)", rest)[1]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "block" if url in listed else "allow")


def test_urls_equal_brute_force(spark):
    listed = ["http://list.ed/a/", "http://www.LIST.ed/a?utm_x=1&ref=2#f", "http://list.ed/a?b=2&a=1", "http://list.ed/a?a=1&b=2"]  # what the two listed ones below stand for
    rows = [(i, u, "h", "v", "w0") for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, `block.x` string")
    given = spark.createDataFrame([("https://list.ed/a#z",), ("//none",), (None,), ("x://list.ed/a?a=1&b=2",), ("x://list.ed/a?a=1&b=2",), ("http://other.ed/",)], "url string")
    got = urls.judge(pages, given, RULES)
    assert got.columns == ["page_id", "url", "block.x", "host", "path", "rule", "verdict"]
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()) == sorted(((i, *_judged(u, listed)) for i, u, *_ in rows), key=lambda x: x[0])


def test_empty_list_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.ed/")], "page_id long, url string")
    none = spark.createDataFrame([], "url string")
    assert [r["verdict"] for r in urls.judge(pages, none, RULES).collect()] == ["allow"]
    assert urls.judge(pages.limit(0), none, RULES).count() == 0
    assert [r["verdict"] for r in urls.judge(pages, pages, []).collect()] == ["block"]


def test_filter_passes_all_listed_and_few_others(spark, monkeypatch):
    key = lambda lo, hi: spark.range(lo, hi).selectExpr("concat('h.ed/', id) AS key")
    listed, others = key(0, 20_000), key(20_000, 60_000)
    blocks = urls.blocks_for(20_000)
    made = urls.bloom(listed, blocks)
    assert urls.checked(listed, made, blocks).where("maybe").count() == 20_000
    assert urls.checked(others, made, blocks).where("maybe").count() < 120  # 3 in 1,000
    monkeypatch.setattr(urls, "MOST_BLOCKS", 2)  # a filter that lets all pass: the join still decides
    pages = spark.createDataFrame([(i, f"http://h.ed/{i}") for i in range(2000)], "page_id long, url string")
    got = urls.judge(pages, pages.where("page_id % 2 = 0"), []).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 2 == 0) for r in got)


def test_rules_must_differ_and_decide():
    for rules in ([("a", "/", "block"), ("a", "/", "allow")], [("a", "/", "perhaps")], [(f"h{i}", "/", "block") for i in range(300)]):
        with pytest.raises(ValueError):
            urls.rule_of(None, None, rules)


def test_url_plan_is_native(spark):
    plan = QUERIES["op13_blocked_bloom"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan

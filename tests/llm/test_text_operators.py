"""The text operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import itertools
import random
import re
import sys
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tickloom.llm import chat, decontaminate, doubling, html, language, licenses, mixing, near_dedup, quality, suffix_dedup, warc  # noqa: E402
from tickloom.llm.tables import new_path  # noqa: E402
from tickloom.llm.textcodes import Texts  # noqa: E402

DOC = "doc_id long, text string, id string, n int"  # id and n clash with names used inside
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 7))) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=0):
    """Texts with near copies at many distances, exact copies, short, empty and null ones."""
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (5, 9, 40, 80, 120, 200)]
    rows = []
    for b in base:
        rows += [b, b.upper(), "  " + b.replace(" ", "\n") + " "]
        for changes in (1, 2, 3, 4, 6, 9):
            w = b.split()
            for _ in range(changes):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append(" ".join(w))
    rows += ["one two", "One  two", "one", "", None, "   ", "é è", "É è"]
    rng.shuffle(rows)
    return [(k * 3 % 1000, t) for k, t in enumerate(rows)]


def shingle_set(text):
    w = words(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == components(rows)


def test_near_duplicates_that_stars_miss(spark):
    """A chain of documents that share most buckets but link only to their neighbours."""
    rng = random.Random(5)
    line = prose(rng, 400).split()
    rows = [(i, " ".join(line[8 * i : 8 * i + 120])) for i in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == components(rows)


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "a b c d e f")]
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect())
    assert got == {(1, 1, True): 2, (None, 1, False): 1, (None, None, True): 1, (7, 1, False): 1}
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    kept = near_dedup.one_of_each(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "id", "n"] and kept.count() == 3
    nameless = [(None, "a b c d e f"), (None, "A b c d e f"), (None, "g h"), (4, "x y z"), (4, "a b c d e f g h i j"), (5, "x y z")]
    assert sorted(r["text"] for r in near_dedup.one_of_each(docs(spark, nameless)).collect())[1:] == ["a b c d e f g h i j", "g h", "x y z"]


def hits(text, items):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, found = tokens(text), set(), set()
    for i, item in items:
        own = tokens(item)
        n = min(10, len(own))
        for k in range(len(own) - n + 1) if own else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == own[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(str(i))
    return len(w), len(hit), found


@pytest.mark.parametrize(("block", "blocks", "joined"), [(1 << 20, 16, 1 << 20), (200, 16, 3), (200, 1, 1)])
def test_decontamination(spark, monkeypatch, block, blocks, joined):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", blocks)
    monkeypatch.setattr(decontaminate, "JOINED", joined)
    rng = random.Random(2)
    items = [(10, prose(rng, 14)), (9, prose(rng, 25)), (3, "short item"), (4, None), (5, ""), (6, "...")]
    a, b = items[0][1], items[1][1]
    items += [(10, a), (12, a), (13, b[: len(b) // 2] + " other end"), (None, a), (14, "item ITEM")]
    rows = [
        (1, prose(rng, 30) + " " + a + " " + prose(rng, 5)), (2, " ".join(b.split()[3:13])), (3, " ".join(b.split()[3:12])), (4, a.upper().replace(" ", "-") + a), (5, "a Short, ITEM! here"), (6, None), (7, ""), (8, "short item short item"), (1, a),
        (9, " ".join(a.split()[:9]) + " x " + " ".join(a.split()[9:])), (None, a), (11, a + " " + prose(rng, 4) + " " + b + " " + a),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(str, ((r["doc_id"], r["n_words"], r["n_hit"], sorted({str(x["item_id"]) for x in r["spans"]})) for r in decontaminate.longest_matches(docs(spark, rows), bench).collect())))
    assert got == sorted(map(str, ((i, *hits(t, items)[:2], sorted(hits(t, items)[2])) for i, t in rows)))
    short = sorted(map(str, ((r["doc_id"], r["n_words"], r["n_hit"], sorted(map(str, r["items"]))) for r in decontaminate.matched_items(docs(spark, rows), bench).collect())))
    assert short == got
    left = decontaminate.decontaminated(docs(spark, rows), bench)
    assert left.columns == ["doc_id", "text", "id", "n"]
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect()) == sorted((str(i), t or "") for i, t in rows if not hits(t, items)[1])
    clash = docs(spark, rows).withColumnsRenamed({"id": "spans", "n": "n_hit"})
    assert decontaminate.decontaminated(clash, bench).columns == ["doc_id", "text", "spans", "n_hit"]


def test_shared_openings_are_not_multiplied():
    """2,000 items that share an opening, in 2,000 places of one text: places and items are listed, not their pairs."""
    opening = " ".join(f"w{k}" for k in range(10))
    block = decontaminate.Block([(str(k), f"{opening} item{k}") for k in range(2000)], 10)
    part = pa.RecordBatch.from_arrays([pa.array([f"{opening} x " * 2000, "clean"]), pa.array([[], []], pa.list_(pa.struct([("doc_word", pa.int64()), ("n_words", pa.int64())]))), pa.array([[], []], pa.list_(pa.string()))], ["text", "runs", "items"])
    tracemalloc.start()
    n_words, n_hit, runs, items = decontaminate._hits(part, [block], 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    assert (n_words.tolist(), n_hit.tolist()) == ([22_000, 1], [20_000, 0])
    assert sorted(items[0].as_py(), key=int) == [str(k) for k in range(2000)] and items[1].as_py() == []
    assert len(runs[0]) == 2000 and runs[0][1].as_py() == {"doc_word": 11, "n_words": 10}


def test_longest_match_is_whole(spark):
    item = " ".join(f"w{k}" for k in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    spans = decontaminate.longest_matches(docs(spark, [(1, "a b " + item + " c"), (2, "z " + " ".join(item.split()[5:20]))]), bench).orderBy("doc_id").collect()
    assert [(x["doc_word"], x["item_word"], x["n_words"]) for r in spans for x in r["spans"]] == [(2, 0, 30), (1, 5, 15)]
    assert decontaminate.longest_matches(docs(spark, [(1, item)]), bench.where("false")).first()["n_hit"] == 0
    assert decontaminate.longest_matches(docs(spark, []), bench).count() == 0


def repeats(rows, length):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def test_suffix_dedup(spark):
    rng = random.Random(3)
    base = prose(rng, 500)
    other = prose(rng, 300)
    rows = [
        (1, "a" * 1500), (2, base), (3, base[300:900] + "zz"), (4, "q" + base[1000:1399] + "w"), (5, "q" + base[1000:1400] + "w"), (None, base), (6, None), (7, ""), (8, "ab" * 400 + base[:450]), (9, "é" * 300), (9, "ü" * 300 + base[-500:]),
        (10, "x" * 399), (11, "x" * 399), (12, "x" * 400), (2, base), (13, other), (14, other[:700] + "#" + other[701:]), (15, other[:200] + other), (16, "ab" * 230),
    ]
    rows += [(17, "s" + other[1200:1480] + "t"), (18, "u" + other[1200:1480] + "v")]
    for length, gram, passage in ((400, 100, 272), (400, 100, 400), (300, 40, 90)):
        found = suffix_dedup.repeated_bytes(docs(spark, rows), length=length, gram=gram, passage=passage).collect()
        assert sorted(str(tuple(r)[:-1]) for r in found) == sorted(map(str, repeats(rows, length)))
        marked = collections.Counter((r["doc_id"], r["n_bytes"]) for r in found if r["shares_passage"])
        shares = lambda n: collections.Counter(x[:2] for x in repeats(rows, n) if x[2])  # noqa: B023, E731
        assert shares(passage) <= marked <= shares(passage - suffix_dedup.WIDE + 1)
    for length in (400, 300, 37):
        slow = doubling.repeated_bytes_by_doubling(docs(spark, rows), length=length).collect()
        assert sorted(map(str, map(tuple, slow))) == sorted(str((x[0], *x[2:])) for x in repeats(rows, length) if x[2])
    cut = suffix_dedup.without_repeats(docs(spark, rows))
    assert cut.columns == ["doc_id", "text", "id", "n"]
    assert {r["doc_id"] for r in cut.collect()} >= {6, 7, 10, 11}
    assert suffix_dedup.repeated_bytes(docs(spark, [])).count() == 0


def without_runs(rows, length):
    """Texts without their runs of words that also stand elsewhere, by brute force; those of white space alone leave."""
    spans = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for _, t in rows]
    named = [[t[a:b] for a, b in own] for (_, t), own in zip(rows, spans, strict=True)]
    count = collections.Counter(tuple(w[k : k + length]) for w in named for k in range(len(w) - length + 1))
    out = []
    for (i, t), own, w in zip(rows, spans, named, strict=True):
        gone = [False] * len(t or "")
        for k in range(len(w) - length + 1):
            if count[tuple(w[k : k + length])] > 1:
                gone[own[k][0] : own[k + length - 1][1]] = [True] * (own[k + length - 1][1] - own[k][0])
        rest = "".join(c for c, g in zip(t or "", gone, strict=True) if not g)
        if not any(gone) or rest.strip(" \t\n\v\f\r"):
            out.append((i, rest if any(gone) else t))
    return out


def test_runs_of_words(spark):
    rng = random.Random(8)
    texts = [prose(rng, 400) for _ in range(4)]
    run = lambda k, a, b: " ".join(words(texts[k])[a:b])
    rows = [
        (1, texts[0]), (2, "x " + run(0, 50, 101) + "\ty"), (3, "z\n" + run(0, 50, 101).replace(" ", " \n", 7) + " é"), (4, "q " + run(0, 200, 250) + " q"), (5, texts[1]), (5, run(1, 10, 90)), (None, run(1, 300, 360)), (6, None), (7, ""), (8, " \n" + run(2, 0, 70) + "\n"),
        (9, texts[2]), (10, run(3, 0, 49) + " ü"), (11, run(3, 0, 49) + " ä"), (12, "a b c d e " * 40), (13, texts[3][:-1]), (14, run(1, 10, 60) + "," + run(1, 60, 130)), (15, run(0, 100, 140) + " " + run(0, 60, 130)), (16, "w " * 50), (17, "v " * 51), (18, texts[2]),
    ]
    for length, gram in ((51, 12), (28, 12), (40, 5)):
        got = [(r["doc_id"], r["text"]) for r in suffix_dedup.without_repeats(docs(spark, rows), length=length, gram=gram, words=True).collect()]
        assert sorted(map(str, got)) == sorted(map(str, without_runs(rows, length)))


def test_pipeline_removes_passages_of_words(spark):
    """A passage of 51 short words, under 400 bytes, goes from both texts; one of 50 words stays."""
    rng = random.Random(12)
    short = [" ".join(str(rng.randrange(10_000)) for _ in range(51)) for _ in range(2)]
    assert max(map(len, short)) < suffix_dedup.LENGTH
    fifty = short[1].rsplit(" ", 1)[0]
    rows = [(1, f"one {short[0]} two"), (2, f"three {short[0]} four"), (3, f"five {fifty} six"), (4, f"seven {fifty} eight"), (5, short[0])]
    got = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["suffix_dedup"](spark, docs(spark, rows), "").collect()}
    assert got == {1: "one  two", 2: "three  four", 3: rows[2][1], 4: rows[3][1]}


def test_quality(spark):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, "a b\na b\n\n\n a b\na b"), (4, prose(rng, 60)), (5, (prose(rng, 9) + "\n") * 6), (6, "x " * 40), (7, "é#* $% |<>&\n" * 3), (8, prose(rng, 30) + " " + "one two three four five six seven eight nine " * 2), (4, "tail"), (None, "a")]
    got = sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in quality.repetition(docs(spark, rows)).collect())
    want = []
    for i, t in rows:
        w = words(t)
        runs = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {x for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for x in range(k, k + 8)}
        seen, again = set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                again += line in seen
                seen.add(line)
        want.append(str((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), again, len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w))))
    assert got == sorted(want)
    rows = [(20, prose(rng, 80)), (21, (prose(rng, 9) + "\n") * 6), (22, prose(rng, 40) + "\n" + "one two three four five six seven\n" * 4), (23, "word " * 120_000)]
    for r in quality.repetition(docs(spark, rows)).collect():
        text = dict(rows)[r["doc_id"]]
        w, chars = words(text), max(sum(map(len, words(text))), 1)
        lines = collections.Counter(x for x in text.split("\n") if words(x))
        shares = [sum(len(x.replace(" ", "")) * n for x, n in lines.items() if n > 1) / chars]
        for n in quality.RUN_LIMITS:
            runs = collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            covered = {x for k in range(len(w) - n + 1) if runs[tuple(w[k : k + n])] > 1 for x in range(k, k + n)}
            shares.append(sum(len(w[x]) for x in covered) / chars)
        limits = [quality.LINE_LIMIT, *quality.RUN_LIMITS.values()]
        assert r["kept"] == (not r["base_failed"] and all(x <= y for x, y in zip(shares, limits, strict=True)))


def test_language(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    table = spark.read.parquet(path)
    learned = language.language_prototypes(table.where(~language.held_out()))
    got = language.identify_language(table, learned).join(table.select("doc_id", "lang", "text"), "doc_id").where("held_out AND length(text) > 40").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    odd = language.identify_language(docs(spark, [(1, None), (2, ""), (3, "12 34 !?"), (None, "the of and with"), (5, "the of and with")]), learned).collect()
    assert [(r["doc_id"], r["lang_pred"], r["held_out"]) for r in odd][:3] == [(i, "und", r["held_out"]) for i, r in zip((1, 2, 3), odd, strict=False)]
    assert odd[3]["lang_pred"] == odd[4]["lang_pred"] == "en" and odd[3]["held_out"] is False and 0 <= odd[4]["score"] <= 1
    assert language.identify_language(docs(spark, [(1, "abc")]), {}).first()["lang_pred"] == "und"
    marked = language.with_language(docs(spark, [(1, "the of")]), learned)
    assert marked.columns == ["doc_id", "text", "id", "n", "lang_pred", "score"] and marked.first()["text"] == "the of"


def test_language_vectors():
    """Bundles against a loop over letters, in tiles of every size."""
    texts = ["The cat, the hat!", "", "12 ..", "a", "Ünïcödé straße 𝒳𝒴z", "ab ab ab", "x" * 50, "日本語の文章です。日本"]
    vector = lambda c, place: np.roll(language._letter_vectors(np.array([c], np.uint64), 128, 5)[0], place).astype(int)
    want = []
    for t in texts:
        letters = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 and ord(c) < 0x10000 else ord(c) if c.isalpha() else 0 for c in f" {t} "]
        line = [x for k, x in enumerate(letters) if x or k == 0 or letters[k - 1]]
        total = np.zeros(128, int)
        for x, y, z in zip(line, line[1:], line[2:], strict=False):
            total += vector(x, 2) * vector(y, 1) * vector(z, 0) if y else 0
        want.append(total)
    for tile in (1, 3, 4096):
        language.TILE, before = tile, language.TILE
        found, count = language._Encoder(128, 5).sums(Texts(pa.array(texts)))
        language.TILE = before
        assert (found == np.array(want)).all() and (count > 0).tolist() == [bool(x.any()) for x in want]


def test_language_of_a_long_text_takes_little_memory():
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9F00, 400_000)))
    tracemalloc.start()
    language._Encoder(language.DIMENSIONS, language.SEED).sums(Texts(pa.array([text])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_ties_of_languages(spark):
    learned = language.language_prototypes(spark.createDataFrame([("same words here", "b"), ("same words here", "a"), ("other", "c")], "text string, lang string"))
    assert language.with_language(docs(spark, [(1, "same words here")]), learned).first()["lang_pred"] == "a"


def test_warc(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [
        (1, "u", "a"), (2, None, "a"), (3, "x WARC/1.0\r\n", fake + "zz"), (4, "u", "WARC/1.0\r\n" * 5), (5, "u", None), (6, "u", ""), (7, "u", "é" * 10), (None, "u", "a"), (None, None, None), (8, "u", "q WARC/1.0\r\nContent-Length: 100000\r\n\r\n"), (7, "u", "é" * 10),
        (9, "u", "x" * 3_000_000 + fake), (10, "u", fake + "zz"), (-5, "u", "neg"), (11, "u", "WARC/1."),
    ]
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted(str(tuple(r)) for r in warc.page_records(warc.read_records(spark, path)).collect())
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        b, top = (h or "").encode(), largest.get(h or "")
        first = i is None or i == top
        want.append(str((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else top)))
    assert got == sorted(want)
    empty = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_records(spark, empty).count() == 0


ARTICLE = [
    "First words of a longer paragraph, which goes on for a while and then ends.", "Second one has less to say.", "The third paragraph is about something else again, and mentions cookies, comments and shares of text.",
    "Last words here, then nothing more follows in this text.",
]


def handmade_pages():
    """Pages of one text under names and in layouts that the labelling rule does not know."""
    art = "<h1>The title of it</h1>" + "".join(f"<p>{t}</p>" for t in ARTICLE)
    nav = "<nav><ul><li><a href=/>Home</a></li><li><a href=/x>News</a></li><li><a href=/y>About us</a></li></ul></nav>"
    foot = "<footer><p>(c) 2024 Example, all rights reserved.</p></footer>"
    said = [("Ann", "Nice text, thanks a lot for it."), ("Bob", "I do not agree with the second paragraph."), ("Cem", "Where is the rest?")]
    comments = "<h3>3 Comments</h3><ol>" + "".join(f"<li><b>{n}</b> <time>{k + 3} May 2024</time><p>{t}</p><a href=#>Reply</a></li>" for k, (n, t) in enumerate(said)) + "</ol>"
    side = "<div class='sidebar'><h3>Popular</h3><ul><li><a href=1>One story to read</a></li><li><a href=2>Another story to read</a></li></ul></div>"
    form = "<form action=/s><p>Sign up for our newsletter and get news each week.</p><input name=mail><button>Go</button></form>"
    return {
        "states": f"<body class='sticky-header has-sidebar'>{nav}<article>{art}</article>{side}{foot}", "wrapper": f"<body>{nav}<div class='layout with-sidebar'><article>{art}</article>{side}</div>{foot}",
        "article by name": f"<body>{nav}<article class='cookie-recipes'>{art}</article>{foot}", "plain": f"<body>{art}", "no wrapper": f"<body>{nav}{art}{foot}",
        "discussion": f"<body>{nav}<article>{art}</article><section class='discussion'>{comments}</section>{foot}", "nameless comments": f"<body>{nav}<article>{art}</article><section class='voices'>{comments}</section>{foot}",
        "comments inside": f"<body>{nav}<article>{art}<div id='comments'>{comments}</div></article>{foot}", "open quote": f"<body>{nav}<article>{art.replace('<p>First', '<p class=\"x>First')}</article>{foot}",
        "open quote, closed later": f"<body>{nav}<article>{art.replace('<p>Second', '<p class=\"x>Second').replace('<p>Last', '<p id=\"q\">Last')}</article>{foot}", "form": f"<body>{nav}<div class=content>{art}{form}</div>{foot}",
        "form around all": f"<body><form id=aspnetForm>{nav}<div class=content>{art}</div>{foot}</form>", "notice": f"<body><div class='cookie-notice'><p>We use cookies to make this site better for you.</p><button>OK</button></div>{nav}<main>{art}</main>{foot}",
        "advert amid": f"<body>{nav}<div><div class='post'>{art.replace('<p>Last', '<div class=ad-slot><p>Buy now the best thing there is.</p></div><p>Last')}</div></div>{side}{foot}",
        "header inside": f"<body>{nav}<article><header><h1>The title of it</h1></header>{art.replace('<h1>The title of it</h1>', '')}</article>{foot}",
        "articles as comments": f"<body>{nav}<article class='post'>{art}</article><div class='comments-area'><article class='comment'><p>Great post, I liked reading it very much.</p></article><article class='comment'><p>Same here, do go on like this.</p></article></div>{foot}",
    }


def test_html(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = html.train(pages)

    def plain(fragment):
        """The blocks of a fragment by a plain rule: every tag of a block ends one."""
        text = re.sub(r"<(script|style)\b.*?</\1>", "", fragment, flags=re.S)
        parts = re.split(r"</?(?:" + "|".join(sorted(html.BLOCKS)) + r")\b[^>]*>", text)
        return "\n\n".join(x for x in (" ".join(html.entities.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts) if x)

    for r in html.extract_text(pages, model).join(pages.select("page_id", "html"), "page_id").collect():
        assert r["text"] == plain(re.search(r"<article>(.*)</article>", r["html"], re.S)[1]) and r["n_chars"] == len(r["text"])
    page = "<html><body><header><p>My site, the best one.</p></header><div id='cookie-notice'><p>We use cookies, accept them all please.</p></div><div class='content'><h1>Title</h1><p>First   words &amp; a <a>link</a>, quite long enough to be prose.</p><ul><li>an item</li></ul></div><div class='comments'><p>Nice text, thanks a lot for it.</p></div><form><input></form><footer>(c)</footer></body></html>"
    made = handmade_pages()
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (None, "u", "<p>open <b>tags"), (5, "u", "<div" * 3), (6, "u", "<article>" + "<p>a line of words, and more.</p>" * 40_000), *((10 + k, "u", h) for k, h in enumerate(made.values()))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit("x"), "text": F.lit(3)})
    got = [(r["page_id"], r["text"]) for r in html.extract_text(table, model).collect()]
    main = "Title\n\nFirst words & a link, quite long enough to be prose.\n\nan item"
    assert got[:4] == [(1, main), (2, ""), (3, ""), (1, main)] and len(got) == len(rows)
    assert got[6][1] == "\n\n".join(["a line of words, and more."] * 40_000)
    wrong = {name: text for name, (_, text) in zip(made, got[7:], strict=True) if text != "\n\n".join(["The title of it", *ARTICLE])}
    assert not wrong
    assert html.extract_text(pages.limit(0), html.train(pages.limit(0))).count() == 0


def test_mixing(spark):
    rows = [(k, "w " * (k % 7 + 1), f"s{min(k // 100, 2)}", "en" if k % 3 else None) for k in range(700)] + [(None, "a b", "s0", "en"), (5, None, "s0", "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("n_tokens", F.lit("clash"))
    got = mixing.mix(table, ["lang", "source"], {"lang": {"en": 3.0}, "source": {"s0": 2.0}}, budget_share=0.5, max_epochs=2).collect()
    spent = collections.Counter()
    for r in got:
        spent[r["lang"], r["source"]] += r["n_tokens"]
    supply = collections.Counter()
    for k, t, s, lang in rows:
        supply[lang, s] += len(words(t))
    total = sum(supply.values())
    assert sum(spent.values()) <= total * 0.5 and sum(spent.values()) > total * 0.5 - 8 * len(supply)
    assert all(spent[x] <= 2 * supply[x] for x in spent)
    # within a language, leaves that are not exhausted share by weight
    for lang in ("en", None):
        level = {s: spent[lang, s] / (2.0 if s == "s0" else 1.0) for s in ("s0", "s1", "s2")}
        free = [s for s in level if spent[lang, s] < 2 * supply[lang, s] - 8]
        assert not free or max(level[s] for s in free) - min(level[s] for s in free) <= 8
        assert all(level[s] <= max((level[x] for x in free), default=1e9) + 8 for s in level)
    # an epoch is a prefix: whoever is in epoch 1 is in epoch 0 as well
    first = {r["doc_id"] for r in got if r["epoch"] == 0}
    assert {r["doc_id"] for r in got if r["epoch"] == 1} <= first
    assert mixing.mix(table.limit(0), ["lang", "source"], {}).count() == 0


def test_chat(spark):
    kind = "conv long, turn long, kind string, call_id string, tool string, arguments string, after array<string>, content string, level string"
    rows = [
        (1, 1, "call", "a", "reply", '{"b":1,"a":{"z":1,"y":[1, 2]}}', ["b"], None, "x"), (1, 2, "call", "b", "reply", '{"turn":"x","text":null}', ["a"], None, "x"), (1, 3, "result", "a", None, None, None, 'res "q"', "x"), (1, 3, "result", "zz", None, None, None, None, "x"),
        (1, 4, "call", "c", "reply", "{bad", None, None, "x"), (1, 5, "call", "c", "nope", "{}", ["zzz"], None, "x"), (1, 5, "call", "c", "nope", "{}", ["zzz"], None, "x"), (2, 1, "call", "c", "configure", '{"turn":1,"text":"é"}', None, None, "x"), (2, 2, "call", "d", "configure", '{"turn":2,"text":""}', ["c"], None, "x"),
        (2, 3, "call", "e", "nope", None, ["d", "c"], None, "x"), (None, 1, "call", "c", "configure", "{}", None, None, "x"), (3, None, "call", "c", "configure", "{}", None, None, "x"), (3, 1, "note", "c", None, None, None, None, "x"),
    ]
    got = {(r["conv"], r["turn"], r["kind"], r["call_id"]): r for r in chat.link_tool_calls(spark.createDataFrame(rows, kind), chat.TURN_TOOLS).collect()}
    all_rows = chat.link_tool_calls(spark.createDataFrame(rows, kind), chat.TURN_TOOLS).count()
    assert all_rows == 10 and len(got) == 9
    assert got[1, 1, "call", "a"]["json"] == '{"after":["b"],"arguments":{"a":{"y":[1,2],"z":1},"b":1},"id":"a","tool":"reply","type":"call"}'
    assert got[1, 1, "call", "a"]["level"] is None and got[1, 1, "call", "a"]["linked"] and not got[1, 2, "call", "b"]["linked"]
    assert got[1, 2, "call", "b"]["errors"] == ["final is missing", "text is missing", "turn is not integer"]
    assert got[1, 3, "result", "zz"]["errors"] == ["call is unknown"] and got[1, 5, "call", "c"]["errors"] == ["identifier is taken"]
    assert [got[2, k, "call", c]["level"] for k, c in ((1, "c"), (2, "d"), (3, "e"))] == [0, 1, 2] and got[2, 1, "call", "c"]["valid"]
    assert got[2, 3, "call", "e"]["errors"] == ["arguments are not a JSON object"]
    assert chat.link_tool_calls(spark.createDataFrame([], kind), chat.TURN_TOOLS).count() == 0


def notices(text, templates, threshold):
    """Every window of a template's length against it, then the greedy choice, in plain Python."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, good = split(text), []
    flat = [(name, t) for name, ts in sorted(templates.items()) for t in ts if len(split(t)) > 1]
    for k, (_, t) in enumerate(flat):
        own = set(itertools.pairwise(split(t)))
        size = min(len(split(t)), len(w))
        for p in range(len(w) - size + 1) if size > 1 else ():
            here = set(itertools.pairwise(w[p : p + size]))
            dice = 2 * len(here & own) / (len(here) + len(own))
            if dice >= threshold - 1e-12:
                good.append((-len(here & own), -dice, p, k, size))
    taken, out = set(), []
    for _, minus, p, k, size in sorted(good):
        if not taken & set(range(p, p + size)):
            taken |= set(range(p, p + size))
            out.append((flat[k][0], p, size, round(-minus, 9)))
    return sorted(out, key=lambda x: x[1])


def test_licenses(spark):
    long = licenses.TEMPLATES["MIT"][1]
    bsd = [licenses.TEMPLATES[f"BSD-{k}-Clause"][1] for k in (2, 3)]
    rows = [
        (1, "foo\n" + long.replace(". ", ".\n") + "\nbar baz"), (2, None), (3, ""), (4, "all RIGHTS reserved!"), (5, "x\nReleased under the MIT licence."), (6, "Under the Apache License, Version 2.0.\n\n(CC BY-NC 4.0)"), (4, "nothing"),
        (7, " * ".join(bsd[0].split(", "))), (8, bsd[1] + " and more"), (9, "rights reserved all"), (10, "mit"),
    ]
    got = [(r["doc_id"], list(r["licenses"])) for r in licenses.scan_licenses(docs(spark, rows)).collect()]
    assert got == [(1, ["MIT"]), (2, []), (3, []), (4, ["All-Rights-Reserved"]), (5, []), (6, ["Apache-2.0", "CC-BY-NC-4.0"]), (4, []), (7, ["BSD-2-Clause"]), (8, ["BSD-3-Clause"]), (9, []), (10, [])]
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_licenses_against_windows(spark):
    rng = random.Random(6)
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    small = {"A": ["a b c d", "a a b"], "B": ["b c d a b", "c"], "C": ["d d d d"]}
    mixed = []
    for _ in range(40):  # notices over several lines, damaged, repeated and side by side
        w = " ".join(rng.choice(texts) for _ in range(rng.randint(1, 3))).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(["zz", "", "the license", "\n"])
        mixed.append("\n".join([prose(rng, rng.randint(0, 4)), rng.choice([" ", "\n"]).join(w)]))
    letters = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(120)]
    for lines, pack, threshold in ((mixed, licenses.TEMPLATES, 0.8), (letters, small, 0.8), (letters, small, 0.5)):
        for r in licenses.scan_licenses(docs(spark, list(enumerate(lines))), templates=pack, threshold=threshold).collect():
            assert [(x["license"], x["word"], x["n_words"], round(x["dice"], 9)) for x in r["found"]] == notices(lines[r["doc_id"]], pack, threshold)


def test_licenses_in_linear_time(spark):
    repeated = ["All rights reserved.\n" * 200 + "\n" * 20_000, "All rights reserved.\n" * 20_000, ("x " * 50 + licenses.TEMPLATES["MIT"][1] + "\n") * 500]
    found = licenses.scan_licenses(docs(spark, list(enumerate(repeated))))
    began = time.monotonic()
    assert [r["n_found"] for r in found.orderBy("doc_id").collect()] == [200, 20_000, 500]
    assert time.monotonic() - began < 30


def without(rows, length):
    """Texts without the bytes of strings of that length that also start elsewhere; what is blank then goes."""
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not any(gone) or rest.strip(" "):
            out[i] = rest if any(gone) else t
    return out


def test_pipeline(spark):
    path = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{path}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in before.collect()}
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    one = corpus_pipeline.identify(spark, before, path)
    assert one.columns == before.columns and texts(one) == {i: t for i, t in rows.items() if any(c.isalpha() for c in t or "")}
    learned = language.language_prototypes(before.where(~language.held_out()))
    assert {r["doc_id"]: r["lang"] for r in one.collect()} == {r["doc_id"]: r["lang_pred"] for r in language.identify_language(before, learned).where("lang_pred <> 'und'").collect()}
    two = texts(corpus_pipeline.dedupe(spark, one, path))
    assert two == {i: rows[i] for i, x in components(list(texts(one).items())).items() if x[2]}
    kept = before.where(F.col("doc_id").isin(list(two)))
    three = corpus_pipeline.cut_repeats(spark, kept, path)
    want = without(list(two.items()), suffix_dedup.LENGTH)
    assert texts(three) == want and {r["n_chars"] for r in three.where("length(text) <> n_chars").collect()} == set()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    four = corpus_pipeline.decontaminate(spark, three, path)
    grams = {tuple(w[k : k + 10]) for _, t in items for w in [alnum(t)] for k in range(len(w) - 9)}
    dirty = lambda t: any(tuple(w[k : k + 10]) in grams for w in [alnum(t)] for k in range(len(w) - 9))
    assert all(len(alnum(t)) >= 10 for _, t in items) and texts(four) == {i: t for i, t in want.items() if not dirty(t)}
    last = corpus_pipeline.run(spark, path)
    final = last.collect()
    assert {"doc_id", "text", "n_tokens", "epoch"} <= set(last.columns) and final
    assert all(r["n_tokens"] == len(words(r["text"])) and not dirty(r["text"]) for r in final)
    spent, supply = collections.Counter(), sum(len(words(t)) for t in texts(four).values())
    for r in final:
        spent[r["lang"]] += r["n_tokens"]
    assert 0 < sum(spent.values()) <= supply * 0.5 and spent["en"] == max(spent.values())


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_stages_on_odd_rows(spark):
    """Null ids, texts, languages and sources, repeated rows, columns that clash with inner names, and no rows at all."""
    path = "/root/testdata/sf0.001"
    rng = random.Random(9)
    some = [prose(rng, n) for n in (40, 120, 40, 40)]
    rows = [(1, some[0], "en", "src1"), (1, some[0], "en", "src1"), (None, some[0], None, None), (None, some[1], "de", None), (None, some[1], "de", None), (5, None, "en", "src2"), (6, "", None, "s"), (7, "12 34", "en", "src3"), (8, some[2], "fr", "src5"), (None, None, None, None)]
    table = spark.createDataFrame([(*r, 5, "x", "y", "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, spans string, row string")
    for docs_ in (table, table.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs_, path)
            got = sorted(str((r["doc_id"], r["text"])) for r in out.collect())
            if name != "mixing":
                assert out.columns == docs_.columns
            if docs_ is not table:
                assert not got
            elif name == "language_id":
                assert got == sorted(str(r[:2]) for r in rows if any(c.isalpha() for c in r[1] or ""))
            elif name == "near_dedup":
                assert got == sorted(str(r[:2]) for r in rows if r[:2] != (None, some[0]))
            elif name == "suffix_dedup":  # of the repeated texts one has over 400 bytes and goes, each copy; shorter ones stay
                assert len(some[0]) < suffix_dedup.LENGTH < len(some[1])
                assert got == sorted(str(r[:2]) for r in rows if r[1] != some[1])
            elif name == "decontamination":
                assert got == sorted(str(r[:2]) for r in rows)
            else:  # every row is whole, and all together stay within the budget
                cost = {str(r[:2]): len(words(r[1])) for r in rows}
                assert set(got) <= set(cost) and 0 < sum(cost[g] for g in got) <= sum(len(words(r[1])) for r in rows) * 0.5

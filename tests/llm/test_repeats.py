"""Repeated strings, collocations and periodic runs against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapaudit.llm import blocks, collocations, packing, periodic_runs, queries, substring_dedup, suffix_dedup
from mapaudit.llm.text import mix

SCHEMA = "doc_id long, text string, lang string, id long, marks string, word string, part int, runs string, f long"


def _docs(spark, rows, lang=None):
    return spark.createDataFrame([(d, t, (lang or {}).get(d), 7, "m", "w", 1, "r", 2) for d, t in rows], SCHEMA)


def _plain_strings(rows):
    """The contract's words, one string at a time. Rows of one id rank as one place."""
    first = {}
    texts = [((d is None, d or 0), (t or "").encode()) for d, t in rows]
    for d, raw in texts:
        for i in range(len(raw) - 99):
            place = (d, i)
            key = raw[i : i + 100]
            first[key] = min(first.get(key, place), place)
    out = []
    for (d, raw), (doc, _) in zip(texts, rows):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if first[raw[i : i + 100]] < (d, i):
                gone[i : i + 100] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((doc, len(raw), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passages = [text(n) for n in (15, 22, 30, 60, 120)]
    rows = []
    for d in range(120):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts += [p if rng.random() < 0.5 else p[rng.randint(0, 40) : len(p) - rng.randint(0, 40)], text(rng.randint(0, 30))]
        rows.append((d, " ".join(parts)))
    line = "This line stands in every document of a certain kind, whatever else that document may have to say on it."
    rows += [(200 + k, f"{k} {line}{'' if k % 3 else ' '}{k * 7919}") for k in range(60)]
    rows += [(300, "a" * 1000), (301, "ab" * 400), (302, None), (303, ""), (304, rows[0][1]), (None, rows[1][1]), (None, rows[1][1]),
             (305, rows[5][1] + "x"), (305, "other " * 40), (306, text(30) * 3), (-4, rows[7][1]), (306, "é" * 120)]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_strings_equal_plain_version(spark, parts):
    rows = _texts(4)
    got = suffix_dedup.digests(suffix_dedup.repeated_strings(_docs(spark, rows).repartition(parts)))
    assert sorted(map(tuple, got.collect()), key=str) == _plain_strings(rows)


def test_strings_in_pieces_of_long_texts(spark, monkeypatch):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, "".join(rng.choice("abcdefgh ") for _ in range(20_000)) + passage + passage[:150]), (2, passage[5:2500] * 2)]
    batch = suffix_dedup.pa.RecordBatch.from_arrays([suffix_dedup.pa.array([1, 2]), suffix_dedup.pa.array([t for _, t in rows])], ["id", "text"])
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 1000)
    cfg = suffix_dedup.DEFAULT
    cut = []
    for _, p in suffix_dedup._pieces(iter([batch]), cfg):
        at = suffix_dedup.Pointers(p.data, p.offsets, cfg).anchors()
        cut += [(int(p.doc[0]), int(x) + p.base) for x in at if p.core[0] <= x + p.base < p.core[1]]
    whole = []
    for d, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        whole += [(d, int(x)) for x in suffix_dedup.Pointers(data, np.array([0, len(data)]), cfg).anchors()]
    assert set(whole) <= set(cut)  # a piece may have more at its ends, never fewer
    assert sorted(map(tuple, suffix_dedup.digests(suffix_dedup.repeated_strings(_docs(spark, rows))).collect()), key=str) == _plain_strings(rows)


def test_blocks_carry_any_numbers():
    rng = np.random.default_rng(3)
    part = np.sort(rng.integers(0, 9, 20_000))
    columns = [rng.integers(-(1 << 62), 1 << 62, 20_000), np.sort(rng.integers(0, 99, 20_000)), np.full(20_000, -1)]
    batch = blocks.write(part, 4, columns)
    got = list(blocks.read(iter([batch]), {4: 3}))
    assert [k for k, _ in got] == [4] * 9
    for k in range(3):
        assert (np.concatenate([c[k] for _, c in got]).view(np.int64) == columns[k]).all()
    assert blocks.write(part[:0], 4, [c[:0] for c in columns]).num_rows == 0


def _plain_phrases(rows, lang, best=2000):
    one, more, total = Counter(), Counter(), Counter()
    for d, text in rows:
        of = lang.get(d) or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[of] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    (one if k == 1 else more)[(of, *w[i : i + k])] += 1
    count = one + more
    out = []
    for (of, *w), a in more.items():
        if a < 10:
            continue
        if len(w) == 2 and any(b >= 10 and 100 * b >= 50 * a for (o, *x), b in more.items() if o == of and len(x) == 3 and w in (x[:2], x[1:])):
            continue
        cuts = [(10**6 * a * a // (count[(of, *w[:k])] * count[(of, *w[k:])]), k, count[(of, *w[:k])], count[(of, *w[k:])]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.append((of, " ".join(w), a, left, right, total[of], score))
    result = []
    for of in total:
        best_of = sorted((x for x in out if x[0] == of), key=lambda x: (-x[6], -x[2], x[1].encode()))[:best]
        result += [(x[0], k, *x[1:]) for k, x in enumerate(best_of, 1)]
    return sorted(result)


def test_phrases_equal_plain_version(spark, monkeypatch):
    rng = random.Random(8)
    words = ["a", "B", "c", "É", "é", "dd", "e-e", "'f"]
    ends = [" ", "  ", "\t", ", ", ".\n", "! ", " \x0b", "\x85 "]
    rows = [(d, "".join(rng.choice(words[: 2 + d % 7]) + rng.choice(ends[: 1 + d % 8]) for _ in range(rng.randint(0, 80)))) for d in range(150)]
    rows += [(200, None), (201, ""), (202, " ,. "), (None, "a B a B"), (3, rows[3][1])]
    lang = {d: ("en", "und", None, "x y")[(d or 0) % 4] for d, _ in rows}
    got = collocations.collocations(_docs(spark, rows, lang))
    assert sorted(map(tuple, got.collect())) == _plain_phrases(rows, lang)
    assert dict(got.dtypes)["rank"] == "bigint"


def test_phrase_scores_pass_64_bits(spark):
    big = 9_000_000_000_000
    rows = spark.createDataFrame([(big, big, big + 1), (big - 7, big, big)], "a long, l long, r long")
    want = [10**6 * a * a // (left * right) for a, left, right in ((big, big, big + 1), (big - 7, big, big))]
    assert [r[0] for r in rows.select(collocations._score("a", "l", "r")).collect()] == want


def test_long_texts_of_phrases_are_cut_at_separators(monkeypatch):
    monkeypatch.setattr(collocations, "PART_BYTES", 50)
    texts = ["one two three, four five. " * 20, "short", None, "no separator at all " * 10]
    batch = collocations.pa.RecordBatch.from_arrays([collocations.pa.array(["en"] * 4), collocations.pa.array(texts)], ["lang", "text"])
    got = Counter()
    for lang, data, offsets in collocations._texts(iter([batch])):
        w = collocations.Words(lang, data, offsets)
        got.update(zip(*(x.tolist() for x in w.phrases()[:2])))
    whole = collocations.Words(["en"] * 4, *collocations.text_bytes(batch.column("text")))
    assert got == Counter(zip(*(x.tolist() for x in whole.phrases()[:2])))


def _plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        x = 0
        while x + q < len(w):
            y = x
            while y + q < len(w) and w[y] == w[y + q]:
                y += 1
            if y + q - x >= max(6, 4 * q):
                out.setdefault((x, y + q - x), q)
            x = max(y, x + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


def test_runs_equal_plain_version():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = []
            while len(w) < rng.randint(0, 120):
                p = [rng.randint(0, 2) for _ in range(rng.randint(1, 9))]
                w += (p * rng.randint(1, 9))[: rng.randint(1, 60)]
            texts.append(w)
        ids = mix(np.array([x for w in texts for x in w], np.uint64) + np.uint64(9))
        edges = np.cumsum([0, *map(len, texts)])
        assert periodic_runs.find_runs(ids, edges) == [(t, *r) for t, w in enumerate(texts) for r in _plain_runs(w)]
    assert periodic_runs.find_runs(mix(np.zeros(50_000, np.uint64)), np.array([0, 0, 50_000])) == [(1, 0, 50_000, 1)]


def test_runs_of_documents(spark):
    rng = random.Random(2)
    rows = [(d, " ".join(rng.choice("ab cd ef g".split()) for _ in range(rng.randint(0, 70))) + rng.choice(["", " \n", "\t x"])) for d in range(300)]
    rows += [(400, None), (401, ""), (402, " \n "), (None, "a " * 9), (5, rows[5][1]), (403, "é ü " * 30)]
    got = {}
    for r in periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_periods(_docs(spark, rows)))).collect():
        got.setdefault(r.doc_id, []).append(tuple(r))
    planted = 0
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = _plain_runs(w)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
        assert (d, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *sha) in got[d]
    assert planted > 10


def test_empty_tables(spark):
    none = _docs(spark, [])
    for found in (suffix_dedup.digests(suffix_dedup.repeated_strings(none)), collocations.collocations(none),
                  periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_periods(none)))):
        assert found.count() == 0


def test_unique_fields_between_repeats_stay(spark):
    rng = random.Random(6)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))

    rows = []
    for k in range(1000):
        a, b = words(40).capitalize() + ".", words(40).capitalize() + "."
        field = f"{k * 37 + 100_000}"
        form = (f"{a} Total {{}}. {b}", f"{a}\n{{}}\n{b}")[k % 2]
        rows += [(2 * k, form.format(field)), (2 * k + 1, form.format("x" + field))]
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(_docs(spark, rows)).collect()}
    assert all(f"x{k * 37 + 100_000}" in got[2 * k + 1] for k in range(1000))
    assert sum(len(got[2 * k + 1]) < 200 for k in range(1000)) > 980


def test_plain_words_equal_the_library():
    tokens = packing.load(queries.BYTE_BPE)
    rng = random.Random(3)
    letters = "aZé ŝ09½ \n\t\r  '.,-ts'llve're" + "ªµ²×÷¿ȡ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    texts += ["'" * 5, " '", "x  y   z", "\n \n", "it's don't 'S  's\n's", "a" * 300 + " " + "b" * 200 + "'s", "<|endoftext|>hi", "日本 x"]
    for a in range(0, len(texts), 500):
        want = [np.array(e.ids, "<u4").tobytes() for e in tokens.library.encode_batch(texts[a : a + 500], add_special_tokens=False)]
        assert tokens.encode(texts[a : a + 500]) == want

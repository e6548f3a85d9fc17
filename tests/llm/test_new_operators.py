"""Collocations, tokenizer alignment and top-k search against brute force; corpus queries on
workers that have no copy of the package; cases that once were lost."""

import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_operators import EDGE, documents, prose

from menuloom.llm import alignment, collocations, decontamination, embedding_dedup, mixing, pii, topk, toxicity

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


# --- collocations ---------------------------------------------------------------

def mined(rows, support=30, reported=2000, longest=4):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= support}
        scored = []
        for p, a in candidates.items():
            if any(100 * b >= 80 * a for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:reported], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(map(repr, out))


@pytest.mark.parametrize("settings", [{}, {"block": 300, "window": 50}, {"sent": 3, "block": 2000}, {"reported": 7, "block": 1, "window": 1}])
def test_collocations(spark, settings):
    rng = random.Random(21)
    phrases = ["New York City hall", "machine learning", "à la carte", "x\x1cy z", "ab cd ab cd"]
    rows = []
    for i in range(260):
        parts = [rng.choice(phrases) if rng.random() < 0.5 else prose(rng, rng.randrange(6), 7) for _ in range(12)]
        rows.append((i, "".join(p + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\x0b", "; "]) for p in parts), rng.choice(["en", "en", "en", "de", None, "und"])))
    rows += EDGE + [(900, "w " * 5000, "en"), (901, "la " * 40 + "Z" * 3000, None), (902, rows[0][1], "en"), (902, rows[0][1], "en")]
    got = collocations.collocations(documents(spark, rows), **settings)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = mined([(r[1], r[2] if len(r) > 2 else None) for r in rows], reported=settings.get("reported", 2000))
    assert len(want) > 10
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_collocations_without_rows(spark):
    assert collocations.collocations(documents(spark, [])).count() == 0
    assert collocations.collocations(documents(spark, [(1, None), (2, "few words")])).count() == 0


def test_pieces_never_touch():
    """Places of neighbouring words differ by one within a piece, and by more across pieces."""
    block = collocations.Block()
    block.add("en", [b"a b", b"", b"c"], True)
    block.add("en", [b"d e"], False)  # goes on with the piece of c
    block.add("en", [b"f"], True)
    at = np.concatenate(block.at)
    assert np.diff(at).tolist() == [1, 3, 1, 1, 2]


# --- alignment ------------------------------------------------------------------

def aligned(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    own = alignment.Aligner(*alignment.Vocabularies(*PATHS).plain())
    per, count = [], Counter()
    for i, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        spelt = [[own.bytes_a[x] for x in a], [own.bytes_b[x] for x in b]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelt):
            per.append((i, None))
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
        starts = [[0, *e[:-1]] for e in ends]
        links, low = [], 0
        for x in range(len(a)):
            while ends[1][low] <= starts[0][x]:
                low += 1
            j = low
            while j < len(b) and starts[1][j] < ends[0][x]:
                links.append((a[x], b[j]))
                j += 1
        groups, x, y = [], 0, 0
        for end in sorted({*ends[0]} & {*ends[1]}):
            x0, y0 = x, y
            while x < len(a) and ends[0][x] <= end:
                x += 1
            while y < len(b) and ends[1][y] <= end:
                y += 1
            groups.append(",".join(map(str, a[x0:x])) + "|" + ",".join(map(str, b[y0:y])))
        count.update(links)
        per.append((i, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for i, p in per:
        if p is None:
            out.append((i, *[0] * 6, ""))
        else:
            out.append((i, *p[:3], len(p[3]), sum(count[l] == most[l[1]] for l in p[3]), sum(count[l] for l in p[3]), p[4]))
    return sorted(map(repr, out))


TEXTS = EDGE + [
    (20, "  two  spaces \n x  "), (21, "a ▁ b"), (22, "<|endoftext|> <s> <0x41> </s>"), (23, "日本語" * 200 + " x"), (24, "x" * 900), (24, "x" * 900),
    (25, "foo "), (26, "　 a  b \x1c c\t d"), (27, " lead " * 120 + "  "), (28, "don't I'll we've  'tis  é́ 🙂🙂 naïve"), (29, " "), (30, "\n \n"), (None, "a\x00b c" * 50),
]


@pytest.mark.parametrize("settings", [{}, {"long": 30, "chunk": 7, "fan": 2}, {"long": 100, "chunk": 41, "fan": 3, "pairs": 3}, {"pairs": 3}])
def test_alignment(spark, settings):
    rng = random.Random(22)
    bits = ["ing", " ", " ", "  ", "The", "é", "123", "\n", "!!", "'s", "中", " of", " a", "🙂"]
    rows = TEXTS + [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(80)))) for i in range(150)]
    got = alignment.align(documents(spark, rows), *PATHS, **settings)
    assert sorted(repr(tuple(r)) for r in got.collect()) == aligned(rows)


def test_alignment_without_rows(spark):
    assert alignment.align(documents(spark, []), *PATHS).count() == 0


def test_composing_is_associative():
    """However neighbouring fragments are composed, the same runs come out."""
    rng = random.Random(23)
    for _ in range(400):
        text = "".join(rng.choice("ab  \n") for _ in range(rng.randrange(1, 40)))
        cuts = sorted({0, *(rng.randrange(len(text)) for _ in range(6)), len(text)})
        whole = []
        for _ in range(3):
            parts, closed = [], []
            for a, b in zip(cuts, cuts[1:]):
                f, more = alignment.fragment(a, text[a:b])
                parts.append(f)
                closed += more
            while len(parts) > 1:
                i = rng.randrange(len(parts) - 1)
                f, more = alignment.compose(parts[i], parts[i + 1])
                parts[i : i + 2] = [f]
                closed += more
            start, prefix, met, suffix, at = parts[0]
            closed += [(start, prefix), (at, suffix)] if met else [(start, prefix)]
            whole.append([r for _, part in sorted(closed) for r in alignment.runs(part)])
        assert whole[0] == whole[1] == whole[2] == alignment.runs(text), repr(text)


def test_every_character_comes_back():
    own = alignment.Aligner(*alignment.Vocabularies(*PATHS).plain())
    keys = [f"a{chr(c)}b" for c in range(0x30000) if not 0xD800 <= c < 0xE000 and chr(c) not in " ▁"]
    a, _, b, _, _ = own.spell(keys)
    text = b"".join((" " + k).encode() for k in keys)
    assert b"".join(own.bytes_a[i] for i in a) == text == b"".join(own.bytes_b[i] for i in b)


def test_remembered_runs_are_bounded():
    files = alignment.Vocabularies(*PATHS).plain()
    small, large = alignment.Aligner(*files, remembered=5), alignment.Aligner(*files)
    for n in (3, 9, 2, 4):
        keys = [f"w{i}" for i in range(n)]
        at, other = small.learn(keys), large.learn(keys)
        assert [small.groups[at[k]] for k in keys] == [large.groups[other[k]] for k in keys]
        assert len(small.known) <= 9


# --- top-k search ---------------------------------------------------------------

def nearest(rows, k=5):
    fit = [(n, i, [int(np.floor(256 * np.float64(c))) for c in e]) for n, (i, e) in enumerate(rows) if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    out = []
    for n, i, e in fit:
        if i is not None and i % 50 == 0:
            found = [(-sum(a * b for a, b in zip(e, x)), j is None, j or 0, j) for m, j, x in fit if m != n and len(x) == len(e)]
            out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("settings", [{}, {"bins": 2}, {"block": 7, "query_block": 3, "bins": 16}, {"k": 1}, {"k": 400, "block": 50}])
def test_top_k(spark, settings):
    rng = np.random.default_rng(24)
    x = rng.normal(size=(260, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i * 5, [float(np.float32(v)) for v in e]) for i, e in enumerate(x)]
    rows += [(5000 + i, rows[20][1]) for i in range(40)] + [(100, rows[3][1]), (100, rows[3][1]), (None, rows[3][1]), (None, rows[20][1])]
    rows += [(6000, None), (6050, []), (6001, []), (6100, [1.0, 0.0]), (6101, [0.5, 0.5]), (6150, [1.0]), (6200, [float("nan")] * 6), (6201, [float("inf")] * 6), (6202, [None] * 6), (7000, [0.0] * 6)]
    frame = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<float>, score string, rank int").repartition(3)
    got = topk.top_k(frame, **settings)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == nearest(rows, settings.get("k", 5))


def test_top_k_of_huge_numbers(spark):
    rows = [(50, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [-3e9, 1.0]), (3, [2.0, 5.0]), (4, [1e30, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=9).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 4, 3, 2]  # 1 and 4 both end at the limit


def test_top_k_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty).count() == 0
    assert topk.top_k(spark.createDataFrame([(50, [1.0])], empty.schema)).count() == 0


# --- workers without the package, and cases once lost -----------------------------

ALONE = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from menuloom.session import build_session
spark = build_session("alone", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": {shared!r}, "spark.sql.warehouse.dir": {shared!r}}})
spark.sparkContext.setLogLevel("OFF")
def absent(_):
    import importlib.util
    return importlib.util.find_spec("menuloom") is None
assert spark.sparkContext.parallelize([1]).map(eval("lambda _: __import__('importlib.util').util.find_spec('menuloom') is None")).first()
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", ALONE.format(repo=REPO, shared=str(tmp_path / "shared"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    names = [line.split()[0] for line in run.stdout.splitlines() if line.startswith(("op", "pipeline"))]
    assert len(names) == 14


def test_links_of_every_vector_length(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.999, 0.01], "a"), (4, [5.0], "a"), (5, [2.0], "a"), (6, [-2.0], "a")]
    rows += [(10 + i, [1.0, float(i), 0.0], "a") for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(frame).collect()}
    unit = {i: (len(e), np.array(e) / np.linalg.norm(e)) for i, e, _ in rows}
    for i, (n, x) in unit.items():
        near = [j for j, (m, y) in unit.items() if j != i and m == n and x @ y >= 0.98]
        assert got[i][0] == len(near), i
    assert got[2][1] == got[3][1] == 1 and got[5][1] == 4 and got[6][1] == 6


@pytest.mark.parametrize("text", ["order 17 DE89370400440532013000", "Invoice 7, DE89370400440532013000 due", "The building fund: DE89370400440532013000"])
def test_proved_account_numbers_stay(text):
    assert "DE89" not in pii.redact(text) and "<iban>" in pii.redact(text)


def test_words_nearby_count_whole():
    number = "123-45-6789"
    assert pii.spans(f"SSN {number}") and not pii.spans(f"classnumber {number}")
    assert pii.score("the ship 10.0.0.1 sails", "ip", 9, 17) == pii.START["ip"]
    assert pii.score("border card", "phone", 11, 11) == pii.START["phone"]


def test_items_without_an_id_count(spark):
    body = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(None, body), (7, "short item")], "item_id long, text string")
    docs = documents(spark, [(1, body), (2, "a short item here"), (3, "clean")])
    got = {r["doc_id"]: (sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in decontamination.benchmark_hits(docs, items).collect()}
    assert got == {1: (30, []), 2: (2, ["7"]), 3: (0, [])}


@pytest.mark.parametrize("quality", [1.0, 0.5, 0.25])
def test_bins_of_the_mix_are_even(spark, quality):
    from pyspark.sql import functions as F

    keys = spark.range(400_000).select(mixing.draw_key("id", F.lit(quality)).alias("key"))
    bins = 632
    sizes = [r["count"] for r in keys.groupBy(mixing.bin_number(F.col("key"), bins).alias("bin")).count().collect()]
    assert sum(sizes) == 400_000 and max(sizes) < 5 * 632


def test_one_id_with_many_rows_is_one_labelled_row(spark):
    rng = random.Random(25)
    rows = [(i % 40, prose(rng, 20, 300) + (" snorkfool" if i % 2 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = toxicity.toxicity(documents(spark, rows), labels)
    assert got.count() == 400

"""Corpus operators against brute force, with nulls, empty and long texts, repeated rows,
empty tables and extra columns that have the names of outputs."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from menuloom.llm import decontamination, embedding_dedup, language, licenses, minhash, mixing, pii, substring, token_counts, toxicity
from menuloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, kept boolean, n_words int, component_id string"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """Rows of (id, text[, lang, source]) with extra columns that clash with outputs."""
    full = [(i, t, *(list(rest) + [None, None])[:2], None if t is None else len(t), 7, 0.5, True, 3, "x") for i, t, *rest in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here"), (None, None), (5, "à  b\x1cc d"), (6, "x" * 5000)]


# --- mixing -------------------------------------------------------------------

def water(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        level = (total - sum(cap * sizes[s] for s in capped)) / sum(w[s] for s in rest) if rest else 0
        new = {s for s in rest if w[s] * level > cap * sizes[s]}
        if not new:
            return {s: cap * sizes[s] if s in capped else w[s] * level for s in names}
        capped |= new


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "b", "b", "b", "Ω", None, "tiny"] if i % 40 else ["tiny"])) for i in range(600)]
    rows = [r for r in rows if r[3] != "tiny" or r[0] % 40 == 0] + [(i, t, None, "a") for i, t in EDGE] + [(9001, "", None, "hollow")]
    docs, size = documents(spark, rows), mixing.word_count()
    out = [mixing.mix(docs, size, mixing.prose_quality(size), narrow=n).select("doc_id", "source", "size", "source_size", "target", "taken").toPandas() for n in (True, False, True)]
    key = lambda f: sorted(map(repr, f.itertuples(index=False, name=None)))
    assert key(out[0]) == key(out[1]) == key(out[2])
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(SPACES.findall(t or ""))
    want = water(sizes)
    got = out[0].assign(source=out[0].source.where(out[0].source.notna(), None))
    assert len(got) == len(rows)
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    for s, part in got.groupby("source", dropna=False):
        s = None if s != s else s
        assert part.target.iloc[0] == pytest.approx(want[s])
        assert part.source_size.iloc[0] == sizes[s]
        assert want[s] - 4 <= part.taken.sum() <= want[s] + 1e-6


def test_mixing_without_rows(spark):
    docs, size = documents(spark, []), mixing.word_count()
    assert mixing.mix(docs, size, mixing.prose_quality(size)).count() == 0
    nothing = documents(spark, [(1, None, None, None)])
    assert mixing.mix(nothing, size, mixing.prose_quality(size)).first()["taken"] == 0


def test_better_documents_come_sooner(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 2 == 0, "s").otherwise("t").alias("source"))
    docs = docs.withColumn("q", F.when(F.col("doc_id") % 4 < 2, 1.0).otherwise(0.25))
    out = mixing.mix(docs, F.lit(4).cast("long"), F.col("q"), weights=(1, 3)).toPandas()
    part = out[out.source == "s"]
    assert part.taken.sum() == pytest.approx(part.target.iloc[0], abs=1)
    assert part[part.q == 1.0].taken.sum() > 1.8 * part[part.q == 0.25].taken.sum()


# --- substring ----------------------------------------------------------------

def removed(texts, window):
    words = [SPACES.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window", [3, 12, 35])
def test_substring(spark, window):
    rng = random.Random(window)
    passages = [prose(rng, n) for n in (window - 1, window, window + 1, 3 * window, 200)]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randrange(0, 90), rng.choice([2, 40])) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages) if rng.random() < 0.4 else "")
        if rng.random() < 0.1:
            parts.append(" ".join(["la"] * rng.choice([5, window, window + 1, 300])))
        if rng.random() < 0.1:
            parts.append(" ".join(["ab", "cd"] * rng.choice([5, window])))
        rows.append((i, "\n".join(parts)))
    rows += EDGE + [(500, rows[0][1]), (501, rows[0][1]), (501, rows[0][1]), (502, prose(rng, 30_000, 5000))]
    got = substring.remove_repeats(documents(spark, rows), window=window).toPandas()
    want = [(i, *x) for (i, _), x in zip(rows, removed([t for _, t in rows], window))]
    key = lambda r: tuple(map(repr, r))
    assert sorted((key((None if a != a else int(a), b, c, d)) for a, b, c, d in got[["doc_id", "n_words", "n_removed", "kept"]].itertuples(index=False))) == sorted(map(key, want))


def test_substring_without_rows(spark):
    assert substring.remove_repeats(documents(spark, [])).count() == 0


# --- tokens -------------------------------------------------------------------

def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "The", "'s", "'re", "9", "1234", ".", "!!", "é", " ", "　", "<|endoftext|>", "中", "\x1c", "\x85", "ing", " \n", "naïve", "a" * 300]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(1500)] + EDGE
    got = token_counts.token_counts(documents(spark, rows), path).toPandas()
    library = Tokenizer.from_file(path)
    want = [(None if i is None else i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows]
    have = [(None if a != a else int(a), b, c) for a, b, c in got[["doc_id", "n_bytes", "n_tokens"]].itertuples(index=False)]
    assert sorted(map(repr, have)) == sorted(map(repr, want))
    assert (got.over_limit == (got.n_tokens > 512)).all()


def test_remembered_counts_are_bounded():
    import public_tokenizers

    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"), remembered=3)
    assert [counter.count(" ".join(map(str, range(n)))) for n in (50, 50)][0] == counter.count(" ".join(map(str, range(50))))


# --- embeddings ---------------------------------------------------------------

def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)
    monkeypatch.setattr(embedding_dedup, "VISITORS", 32)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres[rng.integers(0, 40, 300)] + 0.1 * rng.normal(size=(300, 16)), rng.normal(size=(200, 16))])
    rows = [(i, [float(v) for v in row], int(rng.integers(0, 3)), 1) for i, row in enumerate(x)]
    rows += [(1000 + i, rows[7][1], rows[7][2], 2) for i in range(60)] + [(2000, [v * 3 for v in rows[7][1]], rows[7][2], 2)]
    rows += [(3000, None, 1, 0), (3001, [], 1, 0), (3002, [0.0] * 16, 1, 0), (3003, [float("nan")] + [1.0] * 15, 1, 0), (3004, [None] + [1.0] * 15, 1, 0),
             (3005, [float("inf")] + [1.0] * 15, 1, 0), (3006, rows[7][1], None, 0), (None, rows[7][1], rows[7][2], 0), (3007, [1.0], 1, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links int").repartition(4)
    data = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    got = {(-1 if a != a else int(a)): (b, -1 if c != c else int(c), d) for a, b, c, d in embedding_dedup.near_vectors(frame).toPandas().itertuples(index=False)}
    ok = [(i, np.array(e, float), y) for i, e, y in data if i is not None and y is not None and e and len(e) == 16 and None not in e and np.isfinite(np.array(e, float)).all() and any(e)]
    unit = {i: e / np.linalg.norm(e) for i, e, _ in ok}
    links = defaultdict(set)
    for (a, _, y), (b, _, z) in itertools.combinations(ok, 2):
        if y == z and unit[a] @ unit[b] >= 0.98:
            links[a].add(b)
            links[b].add(a)
    assert sum(map(len, links.values())) > 3000
    for i, _, _ in data:
        i = -1 if i is None else i
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == (len(links[i]), min(seen), i in (-1, min(seen))), i


def test_embeddings_without_rows(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(frame).count() == 0
    one = spark.createDataFrame([(1, None, 3)], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(one).first().asDict() == {"vec_id": 1, "n_links": 0, "component_id": 1, "kept": True}


# --- personal data ------------------------------------------------------------

def plain_base_spans(text):
    """The patterns as they are stated, without any care for speed."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    checks = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    )
    found = [(m.start(), n, k, m.end()) for n, (k, p, check) in enumerate(checks) for m in re.finditer(p, text) if check(m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_personal_data(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "@", ".", "-", " ", "1", "22", "255", "256.1.1.1", "10.0.0.7", "+1 (377) 555-0271", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "x", "%", "é", "@mail.example", "(", ")", "DE89 3704 0044 0532 0130 00"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(3000)] + EDGE
    got = pii.find_personal_data(documents(spark, rows)).collect()
    have = sorted((repr(r["doc_id"]), str([(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in pii.BASE])) for r in got)
    assert have == sorted((repr(i), str(plain_base_spans(t or ""))) for i, t in rows)


def test_personal_data_takes_linear_time():
    for text in ("a" * 300_000, "a." * 200_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "@" * 200_000, "A1" * 150_000, "1 " * 150_000):
        pii.spans(text)


def test_further_kinds_and_context():
    found = pii.spans("Please transfer to account DE89 3704 0044 0532 0130 00, my SSN is 123-45-6789.")
    assert [k for _, k, _, _ in found] == ["iban", "national_id"]
    assert not [s for s in pii.spans("DE89 3704 0044 0532 0130 01 part no 123-45-6789") if s[1] in ("iban", "national_id")]
    assert pii.redact("mail a@b.cd or +1 (377) 555-0271!") == "mail <email> or <phone>!"


def test_ibans_before_capital_words_and_numbers():
    numbers = ("DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606")
    for number in numbers:
        for before in ("", "IBAN ", "AB12 ", "DE89 3704 0044 0532 0130 01 "):
            for after in ("", ".", " x", " BIC COBADEFFXXX", " A payment", " 12 May", " 7 " + number, " A" * 40):
                text = before + number + after
                at = [i for i in range(len(text)) if text.startswith(number, i)]
                assert list(pii.ibans(text)) == [(i, i + len(number)) for i in at], text
    assert pii.redact("to DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX") == "to <iban> BIC COBADEFFXXX"
    assert not list(pii.ibans("DE89 3704 0044 0532 0130 01 BIC COBADEFFXXX")) and not list(pii.ibans("DE89370400440532013000X"))
    # A code without a known length.
    assert list(pii.ibans("ZZ81 1234 5678 901 AB")) == [(0, 18)] and not list(pii.ibans("ZZ82 1234 5678 901 AB"))
    for text in ("AB12 " * 60_000, "A" * 200_000, "DE89 3704 0044 0532 0130 01 " * 10_000):
        assert not [s for s in pii.spans(text) if s[1] == "iban" and text[s[0] : s[2]].endswith("01")]


def test_redacted_rows(spark):
    docs = documents(spark, [(1, "write to a@b.cd"), (2, None), (3, "clean")])
    out = {r["doc_id"]: r for r in pii.without_personal_data(docs).collect()}
    assert out[1]["text"] == "write to <email>" and out[1]["n_chars"] == len("write to <email>")
    assert out[2]["text"] is None and out[3]["text"] == "clean" and out[3]["score"] == 0.5


# --- near duplicates ----------------------------------------------------------

def shingles(text):
    w = SPACES.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y:
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                a, b = sorted((root(a), root(b)))
                up[b] = a
    return sorted(repr((i, len(s), None if i is None else root(i), i is None or root(i) == i)) for i, s in sets)


def test_near_duplicates(spark):
    rng = random.Random(6)
    rows = []
    for g in range(25):
        base = prose(rng, rng.choice([3, 6, 40, 150]), 500).split()
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
            rows.append((len(rows) * 7 % 1009 + 10, " ".join(w).upper() if rng.random() < 0.2 else "  ".join(w)))
    rows += EDGE + [(5000, "same few words"), (5001, "SAME few\twords"), (5002, prose(rng, 20_000, 9000))]
    got = minhash.near_duplicates(documents(spark, rows)).toPandas()
    have = sorted(repr((None if a != a else int(a), b, None if c != c else int(c), bool(d))) for a, b, c, d in got.itertuples(index=False))
    assert have == near_components(rows)
    kept = minhash.without_near_duplicates(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert kept.count() == int(got.kept.sum())


def test_chains_whose_hub_is_far(spark):
    """Members that link with each other but not with the smallest of their bucket."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(i % 6):
            w[(20 * k + 7) % 120] = f"v{i % 6}_{k}"
        w[rng.randrange(110, 120)] = f"t{i}"
        rows.append((i + 1, " ".join(w)))
    got = minhash.near_duplicates(documents(spark, rows)).toPandas()
    assert sorted(repr((int(a), b, int(c), bool(d))) for a, b, c, d in got.itertuples(index=False)) == near_components(rows)


def test_near_duplicates_without_rows(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


# --- decontamination ----------------------------------------------------------

def benchmark_brute(docs, items, window):
    lower = lambda t: decontamination.normal_words(t)
    owners = defaultdict(set)
    for name, t in items:
        w = lower(t)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            owners[tuple(w[i : i + n])].add(str(name))
    out = []
    for i, t in docs:
        w, hit, names = lower(t), set(), set()
        for n in {len(k) for k in owners}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in owners:
                    hit.update(range(j, j + n))
                    names |= owners[tuple(w[j : j + n])]
        out.append(repr((i, len(w), len(hit), sorted(names))))
    return sorted(out)


@pytest.mark.parametrize("shard_words", [100_000, 60])
def test_decontamination(spark, shard_words):
    rng = random.Random(8)
    items = [(n, prose(rng, rng.choice([1, 4, 12, 13, 14, 40, 90]), 30)) for n in range(25)] + [(90, None), (91, "--"), (3, prose(rng, 20, 30)), (92, "la " * 30)]
    docs = []
    for i in range(80):
        parts = [prose(rng, rng.randrange(60), rng.choice([30, 400]))]
        if rng.random() < 0.5:
            w = (rng.choice(items)[1] or "").split()
            k = rng.randrange(len(w) + 1)
            parts.append(", ".join(w[k // 2 :]).upper())
        docs.append((i, "\n".join(parts)))
    docs += EDGE + [(700, "la-" * 500), (701, "A éB " + items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.benchmark_hits(documents(spark, docs), bench, shard_words=shard_words)
    have = sorted(repr((r["doc_id"], r["n_words"], r["n"], r["items"])) for r in got.select("*", decontamination.n_hit().alias("n")).collect())
    want = benchmark_brute(docs, [(n, t) for n, t in items], 13)
    assert have == want
    kept = decontamination.decontaminate(documents(spark, docs), bench, shard_words=shard_words)
    bad = [eval(x) for x in want]  # noqa: S307
    assert kept.count() == sum(not (h > 0 and 20 * h >= n) for _, n, h, _ in bad)


def test_automata_are_held_one_at_a_time(spark, monkeypatch):
    """The driver builds none of many shards, unpickles one at a time, destroys each that was
    sent, and no shard is larger than it may be."""
    import gc
    import weakref

    rng = random.Random(12)
    items = spark.createDataFrame([(n, prose(rng, rng.choice([3, 20, 70, 200]), 50)) for n in range(6)], "item_id long, text string").repartition(5)
    dealt, count = decontamination.pieces(items, "item_id", "text", 13, 60)
    sizes = [r["n"] for r in dealt.groupBy("shard").agg(F.sum(F.size(F.split(F.col("words").cast("string"), " "))).alias("n")).collect()]
    assert count >= len(sizes) > 2 and max(sizes) <= 60
    live, most, sent, destroyed = weakref.WeakSet(), [], [], []
    real = decontamination.travelling

    def travelling(session, machine):
        live.add(machine)
        gc.collect()
        most.append(len(live))
        out = real(session, machine)
        sent.append(out)
        gone = out.destroy
        out.destroy = lambda *a, **k: (destroyed.append(out), gone(*a, **k))
        return out

    monkeypatch.setattr(decontamination, "travelling", travelling)
    driver, plain = os.getpid(), decontamination.Automaton.__init__

    def init(self, *args):
        assert os.getpid() != driver, "built on the driver"
        plain(self, *args)

    monkeypatch.setattr(decontamination.Automaton, "__init__", init)
    docs = documents(spark, [(1, "a b c"), (2, None)])
    hits = decontamination.benchmark_hits(docs, items, shard_words=60)
    monkeypatch.undo()
    assert hits.count() == 2 and len(sent) == len(sizes) and len(destroyed) == len(sent) and max(most) <= 2


def test_cut_spans(spark):
    item = " ".join(f"q{i}" for i in range(13))
    docs = documents(spark, [(1, "Intro. " + prose(random.Random(1), 600) + f" <{item.upper()}>. End"), (2, item), (3, None)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontamination.decontaminate(docs, bench).collect()}
    assert set(out) == {1, 3} and out[1]["text"].endswith("<>. End") and out[1]["n_chars"] == len(out[1]["text"])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(docs, empty).count() == 3
    assert decontamination.benchmark_hits(docs, empty).select(F.sum(decontamination.n_hit())).first()[0] == 0


# --- languages and toxicity ---------------------------------------------------

def held(i, parts, part):
    import zlib

    return zlib.crc32(str(i).encode()) % parts == part


def test_language(spark):
    rng = random.Random(9)
    sounds = {"aa": "bada gola mira", "bb": "xtl qrk vzn", "cc": "øyø æjå våø", "dd": "миру дому лесу", "ee": "そら うみ やま", "ff": "şığ üçö ğış", "gg": "νερο φωσ γη"}
    text = lambda k: " ".join("".join(rng.choice(sounds[k].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 40)))
    rows = [(i, text(k := rng.choice(list(sounds))), k if i % 11 else None) for i in range(700)]
    rows += [(9000 + n, t, "aa") for n, (_, t) in enumerate(EDGE)] + [(None, "bada", "aa"), (9100, "12 34 !!", "bb")]
    got = language.identify(documents(spark, rows)).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    pred = dict(zip(got.doc_id, got.lang_pred))
    test = [(i, k) for i, _, k in rows if i is not None and i < 9000 and k and held(i, 3, 1)]
    assert np.mean([pred[i] == k for i, k in test]) > 0.98
    assert pred[9000] == pred[9001] == pred[9002] == pred[9100] == "und"
    assert all(h == held(int(i), 3, 1) for i, h in zip(got.doc_id, got.held_out) if i == i)


def test_language_without_labels(spark):
    assert language.identify(documents(spark, [])).count() == 0
    assert language.identify(documents(spark, [(1, "some text")])).first()["lang_pred"] == "und"
    one = language.identify(documents(spark, [(i, "some text", "xx") for i in range(9)])).toPandas()
    assert set(one.lang_pred) == {"xx"} and set(one.score) == {1.0}


@pytest.mark.parametrize("n", [2, 3, 6, 7, 40])
def test_code_words_differ(n):
    code = language.code_words(n)
    least = min(np.sum(a != b) for a, b in itertools.combinations(code, 2))
    assert least >= (1 if n == 2 else code.shape[1] // 4)


def test_language_on_the_shared_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_toxicity(spark):
    rng = random.Random(10)
    bad = ["blarg", "snorkfool", "dweebish", "grubber"]
    rows, labels = [], []
    for i in range(900):
        w = prose(rng, rng.randrange(10, 80), 300).split()
        y = rng.random() < 0.2
        for _ in range(rng.choice([2, 3, 5]) if y else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "!!", ","]))
        if i % 50 == 0 and y:
            w.append("bl4rg")
        rows.append((i, " ".join(w)))
        labels.append((i, None, int(y)))
    labels += [(5, 1, None), (None, 1, 1), (77777, 1, 1), (6, 1, labels[6][2])]
    docs = documents(spark, rows + [(9000 + n, t) for n, (_, t) in enumerate(EDGE)] + [(None, "x")])
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, frame).toPandas()
    assert len(got) == len(rows) + len(EDGE) + 1 and got.score.between(0, 1).all()
    pred = dict(zip(got.doc_id, got.predicted))
    test = [(i, y) for i, _, y in labels[:900] if held(i, 4, 2)]
    assert np.mean([pred[i] == y for i, y in test]) > 0.98
    assert pred[9000] == pred[9001] == 0
    assert (got.predicted == (got.score >= 0.3)).all()
    kept = toxicity.without_toxic(docs, frame)
    assert kept.columns == docs.columns and kept.count() == int((got.predicted == 0).sum())


def test_toxicity_without_labels(spark):
    frame = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, [(1, "a"), (2, None)])
    assert [r["score"] for r in toxicity.toxicity(docs, frame).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(documents(spark, []), frame).count() == 0
    ones = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs, ones).collect()} == {0}


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert list(y) == [0, 0.5, 1] and list(x) == [1, 2.5, 4]


def test_spelling_tricks_are_undone():
    lexicon = toxicity.Lexicon({"stupid": 4.0, "mor*": 3.0})
    assert toxicity.features("you st0pid stup1d m0ron", lexicon)[4] == 2
    assert lexicon.values([b"stupid", b"moron", b"fine"]) == [4.0, 3.0, 0.0]


def test_toxicity_on_the_shared_tables(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97


# --- licences -----------------------------------------------------------------

def test_licences(spark):
    rows = [
        ("r/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person"),
        ("r/src/a.c", "int x;"), ("r/src/deep/er/b.c", None),
        ("r/gpl/x.c", "hello\n// This work is licensed under the GNU General Public License, version 3.\nint y;"), ("r/gpl/y.c", ""),
        ("r/gpl/sub/z.c", "nothing here"), ("other/f.c", "nothing"), (None, "text"), ("r/src/a.c", "int x;"),
    ]
    frame = spark.createDataFrame([(i, p, t, "l") for i, (p, t) in enumerate(rows)], "doc_id long, p string, text string, licence string").repartition(3)
    got = {r["doc_id"]: (r["licence"], r["origin"]) for r in licenses.scan(frame, F.col("p")).collect()}
    assert got == {
        0: ("MIT", "stated"), 1: ("MIT", "inherited"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "stated"), 4: ("GPL-3.0", "inherited"),
        5: ("GPL-3.0", "inherited"), 6: (None, "none"), 7: (None, "none"), 8: ("MIT", "inherited"),
    }
    assert licenses.scan(frame.where("false"), F.col("p")).count() == 0


def test_every_template_finds_itself(spark):
    frame = spark.createDataFrame([(i, f"d{i}/f", t, n) for i, (n, t) in enumerate(sorted(licenses.TEMPLATES.items()))], "doc_id long, p string, text string, name string")
    got = licenses.scan(frame, F.col("p")).join(frame.select("doc_id", "name"), "doc_id").toPandas()
    assert list(got.licence) == list(got.name)


def test_licences_of_the_shared_tables(spark):
    """The whole result against a walk up each path: rows inherit from above their own directory,
    and licence files decide."""
    got = QUERIES["op8_license_scan"](spark, "/root/testdata/sf0.1").collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(docs) and all(r["path"].startswith(docs[r["doc_id"]]["source"] + "/") for r in got)
    is_file = lambda p: re.search(licenses.LICENCE_FILE.replace("(?i)", ""), p, re.I) is not None
    votes, files = defaultdict(Counter), defaultdict(set)
    for r in got:
        if r["origin"] == "stated":
            up = r["path"].rpartition("/")[0]
            votes[up][r["licence"]] += 1
            if is_file(r["path"]):
                files[up].add(r["licence"])
    states = {d: max(v, key=lambda x: (x in files[d], v[x], x)) for d, v in votes.items()}
    distances, decided = Counter(), 0
    for r in got:
        if r["origin"] != "stated":
            parts = r["path"].split("/")[:-1]
            above = next((n for n in range(len(parts), -1, -1) if "/".join(parts[:n]) in states), None)
            want = None if above is None else states["/".join(parts[:above])]
            assert (r["licence"], r["origin"]) == (want, "none" if want is None else "inherited"), r
            distances[None if above is None else len(parts) - above] += 1
            decided += above is not None and bool(files["/".join(parts[:above])])
    assert distances[1] > 100 and distances[2] > 100 and decided > 0
    assert any(files.values())


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")

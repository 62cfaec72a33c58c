"""Each operator against a brute-force version, and with nulls, empty tables, repeats and clashing columns."""

import math
import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import chat, decontaminate, fingerprint, jaccard_join, line_dedup, packing, quality, records, token_counts, toxicity
from sluice.llm.common import DEFAULT_RANKS, SHUFFLE_CLEANUP, Words, encode, shared_dir, tokenizer, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `class` string, __gone string, __id int, h long, `line.no` int"


def table(spark, rows, schema=DOCS):
    width = len(spark.createDataFrame([], schema).columns)
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def words_of(text):
    w = Words([text])
    return [text[a:b].lower() for a, b in zip(w.start, w.end)]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


ODD = [(None, "a text without an id that is long enough to be a line"), (900, None), (901, ""), (902, " \n\t\n"), (903, "...!?")]


# ---------------------------------------------------------------- 1


def brute_spans(rows, items, n=8, least=5):
    out = []
    for doc, text in rows:
        if doc is None or not text:
            continue
        w, words = Words([text]), words_of(text)
        lines = np.cumsum([c == "\n" for c in text])[w.start].tolist() if len(w.start) else []
        for item in {i for i, _ in items if i is not None}:
            wanted = set()
            for p in (words_of(passage or "") for i, passage in items if i == item):
                k = min(n, len(p))
                wanted |= {tuple(p[i : i + k]) for i in range(len(p) - k + 1) if k}
            found = []
            for i in range(len(words)):
                for k in {len(p) for p in wanted}:
                    whole = i + k <= len(words) and lines[i] == lines[i + k - 1] and (not i or lines[i - 1] < lines[i]) and (i + k == len(words) or lines[i + k] > lines[i])
                    if tuple(words[i : i + k]) in wanted and (k >= least or whole):
                        found.append((i, k))
            now = None
            for i, k in sorted(found):
                if now and i <= now[2]:
                    now[1], now[2], now[3] = max(now[1], int(w.end[i + k - 1])), max(now[2], i + k), now[3] + 1
                else:
                    if now:
                        out.append((doc, item, now[0], now[1], now[3]))
                    now = [int(w.start[i]), int(w.end[i + k - 1]), i + k, 1]
            if now:
                out.append((doc, item, now[0], now[1], now[3]))
    return sorted(out)


@pytest.mark.parametrize("item_bytes", [1 << 20, 150])
def test_decontaminate(spark, monkeypatch, item_bytes):
    """With one automaton, and with the items in parts."""
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", item_bytes)
    rng = random.Random(1)
    items = [(1, prose(rng, 30)), (2, "Six short words of one item"), (3, "too short"), (4, None), (None, prose(rng, 20)), (5, prose(rng, 30)), (6, ""), (8, "42"), (8, "seven"), (9, "x y z " * 9)]
    items.append((7, items[0][1]))
    rows = [(i, prose(rng, 60)) for i in range(12)]
    rows[2] = (2, rows[2][1] + "! " + items[0][1].upper().replace(" ", ",\n ") + " und weiter")
    rows[3] = (3, "SIX short -- words of one ITEM, six short words of one item")
    rows[4] = (4, " ".join(items[5][1].split()[3:14]) + " é́ " + prose(rng, 5))
    rows[5] = (5, " ".join(items[5][1].split()[:7]))
    rows += [(20, "an answer\n (42)\nis it"), (21, "it is 42\n42 it is\ntoo short a line\n"), (22, "Too, short!"), (23, "a\n\nseven\n\ntoo\nshort"), (24, "x y z " * 7), (25, "a\U000e0101b six short words of one item\U000e0101"), (26, "İ six short words of one item")]
    rows += [(2, rows[2][1]), *ODD]
    benchmark = table(spark, items, "item_id long, text string, doc_id long, part int")
    found = decontaminate.contaminated_spans(table(spark, rows), benchmark)
    expected = brute_spans(rows, items)
    assert sorted(tuple(r) for r in found.collect()) == expected and {20, 21, 22, 23} & {d for d, *_ in expected} == {20, 22, 23}
    docs = table(spark, rows)
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    leaking = {d for d, *_ in expected}
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(i) for i, _ in rows if i not in leaking)
    assert decontaminate.contaminated_spans(docs, benchmark.limit(0)).isEmpty() and decontaminate.decontaminate(docs, benchmark.limit(0)).count() == len(rows)
    assert decontaminate.contaminated_spans(docs.limit(0), benchmark).isEmpty()


#: More than a batch of characters.
LONG = ("lorem w1x w2x é " * 75_000)[:-1]


def test_decontaminate_long_text(spark):
    text = LONG + "\nsix short words of one item\n" + LONG + "\n42"
    benchmark = table(spark, [(2, "Six short words of one item"), (8, "42")], "item_id long, text string")
    found = decontaminate.contaminated_spans(table(spark, [(30, text), (31, LONG)]), benchmark)
    at = len(LONG) + 1
    assert len(LONG) > 1_000_000 and sorted(tuple(r) for r in found.collect()) == [(30, 2, at, at + 27, 1), (30, 8, len(text) - 2, len(text), 1)]


# ---------------------------------------------------------------- 2


def brute_perplexities(trusted, texts, letters, order):
    """The same model in dictionaries."""
    ids = {c: i + quality.FIRST for i, c in enumerate(letters)}
    coded = lambda t: [quality.START] * (order - 1) + [ids.get(ord(c), quality.OTHER) for c in t] + [quality.END]
    counts = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in map(coded, trusted) for i in range(order - 1, len(s)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, total, weight = {}, {}, {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        known = all(n[i] for i in (1, 2, 3))
        discount[k] = {i: max(0.0, i - (i + 1) * y * n[i + 1] / n[i]) if known else 0.5 * i for i in (1, 2, 3)}
        t, w = Counter(), defaultdict(float)
        for g, x in c.items():
            t[g[:-1]] += x
            w[g[:-1]] += discount[k][min(x, 3)]
        total[k], weight[k] = t, {h: w[h] / t[h] for h in t}

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (len(letters) + 2)
        if g[:-1] not in total[k]:
            return lower
        x = counts[k].get(g, 0)
        return (max(x - discount[k][min(x, 3)], 0) if x else 0) / total[k][g[:-1]] + weight[k][g[:-1]] * lower

    out = []
    for t in texts:
        s = coded(t)
        logs = [math.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))]
        out.append(math.exp(-sum(logs) / len(logs)))
    return out


def test_kneser_ney(spark):
    rng = random.Random(2)
    trusted = [(i, prose(rng, 12, 30), "en") for i in range(12)]
    texts = [(100, "w1x w2x", "en"), (101, "zzz qq", "en"), (102, "", "en"), (103, "w5x w5x w5x é\n", "en"), (104, "w1x", "de")]
    good = table(spark, trusted, "doc_id long, text string, lang string")
    letters = quality.alphabet(good)
    fitted = quality.model(good, letters, 3)
    docs = table(spark, texts, "doc_id long, text string, lang string")
    expected = dict(zip([t[0] for t in texts], brute_perplexities([t[1] for t in trusted], [t[1] for t in texts[:4]], letters, 3)))
    held = {r["doc_id"]: r["perplexity"] for r in quality.score_held(docs, fitted, letters, 3).collect()}
    sharded = {r["doc_id"]: r["perplexity"] for r in quality.score_sharded(docs, fitted, letters, 3).collect()}
    assert held.pop(104) is None and 104 not in sharded
    assert held == pytest.approx(expected) and sharded == pytest.approx(expected)


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40, 60), "en", "s") for i in range(90)] + [(200 + i, "".join(rng.choice("#$%&*qzj{}") for _ in range(200)), "en", "s") for i in range(5)]
    rows += [(300, prose(rng, 10), None, "s"), *ODD, rows[0]]
    labels = table(spark, [(i, 1, 0) for i in range(50)] + [(200, 0, 0), (None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.kept_documents(table(spark, rows), labels)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert sum(i in ids for i in range(90)) >= 85 and not any(i in ids for i in range(200, 205)) and 300 not in ids and ids[0] in (0, 2)
    assert quality.kept_documents(table(spark, rows), labels.limit(0)).isEmpty()
    assert quality.kept_documents(table(spark, []), labels).isEmpty()
    joined = quality.kept_documents(table(spark, rows), labels, held_ngrams=0)
    assert Counter(r["doc_id"] for r in joined.collect()).keys() == ids.keys()


def test_thresholds(spark):
    """Against sorted perplexities: the least grid point with a share of the quantile at or below it."""
    rng = random.Random(33)
    rows = [(lang, rng.choice([math.exp(rng.gauss(2, 0.5)), 7.5])) for lang in ("en", "de", "") for _ in range(rng.randrange(30, 90))] + [("xx", 4.0), ("en", None)]
    for quantile in (0.5, 0.9, 0.99, 1.0):
        expected = {}
        for lang in {x for x, _ in rows}:
            cells = sorted(math.ceil(math.log(p) * quality.GRID) for x, p in rows if x == lang and p)
            expected[lang] = math.exp(next(c for k, c in enumerate(cells) if sum(d <= c for d in cells) >= quantile * len(cells)) / quality.GRID)
        found = quality.thresholds(spark.createDataFrame(rows, "lang string, perplexity double"), quantile)
        assert {r["lang"]: r["threshold"] for r in found.collect()} == pytest.approx(expected)


def test_quality_with_many_letters(spark):
    """More letters than there are ids: a script outside of the most frequent ones is still learnt."""
    rng = random.Random(31)
    han, word = [chr(0x4E00 + i) for i in range(9000)], "აბგდევზთ"
    trusted = [(1, "zh", "".join(han * 20)), (2, "ka", word * 9)]
    junk = list(word * 9)
    rng.shuffle(junk)
    docs = [(3, "ka", word * 5), (4, "ka", "".join(junk)), (5, "zh", "".join(han[100:140])), (6, "zh", "".join(han[8900:8940][::-1])), (7, "ka", "ჩ" * 40), (8, "ka", "")]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, lang string, text string")
    letters = quality.alphabet(make(trusted))
    assert set(letters) == {ord(c) for _, _, text in trusted for c in text}
    codes = quality.ids_table(letters)[np.array(letters)]
    assert len(set(codes.tolist())) == len(letters) and quality.OTHER not in codes
    grams, doc = quality.n_grams(["აბ", "", "ა"], quality.ids_table(letters))
    assert np.bincount(doc).tolist() == [5, 1, 3] and grams[-1] & 0xFFF == quality.END
    fitted = quality.model(make(trusted), letters)
    held, sharded = ({r["doc_id"]: r["perplexity"] for r in score(make(docs), fitted, letters).collect()} for score in (quality.score_held, quality.score_sharded))
    assert held == pytest.approx(sharded)
    assert held[3] * 2 < held[4] and held[5] * 2 < held[6] and held[3] * 2 < held[7]


def test_overlapping_windows_are_not_joined_again_and_again(monkeypatch):
    """Clusters of near copies around a common core: the work of all levels stays within the region's pairs."""
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(20):
        own = rng.choice(360, 120, replace=False)
        sets += [np.unique(np.append(own, 10_000 + len(sets) + rng.integers(0, 3, 9))) for _ in range(8)]
    work, compare = [], jaccard_join.Region.compare
    monkeypatch.setattr(jaccard_join.Region, "compare", lambda self, points, *args: work.append(len(points) ** 2) or compare(self, points, *args))
    found = jaccard_join.close_pairs(sets, 0.6)
    assert found == {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(c := np.intersect1d(sets[i], sets[j])) / (len(sets[i]) + len(sets[j]) - len(c)) >= 0.6}
    assert len(found) >= 20 * 28 and sum(work) <= len(sets) ** 2


def test_quality_in_shards_by_chunks(spark, monkeypatch):
    """Equal rows are scored each, in any number of chunks, and n-grams are joined once for a chunk and not for a document."""
    rng = random.Random(7)
    rows = [(i, "en" if i % 3 else "de", prose(rng, 40)) for i in range(40)]
    rows += [rows[1], rows[1], (1, "de", rows[1][2]), (90, "xx", "none"), (91, "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    letters = quality.alphabet(docs.where("doc_id < 30"))
    fitted = quality.model(docs.where("doc_id < 30 and lang <> 'xx'"), letters)
    monkeypatch.setattr(quality, "plan_bytes", lambda df: 3 * quality.CHUNK_BYTES)
    joined, was = [], quality.log_probabilities
    monkeypatch.setattr(quality, "log_probabilities", lambda grams, *args: joined.append(grams.count()) or was(grams, *args))
    held, sharded = (sorted((r["doc_id"], r["lang"], round(r["perplexity"] or 0, 9)) for r in score(docs, fitted, letters).where("lang <> 'xx'").collect()) for score in (quality.score_held, quality.score_sharded))
    assert held == sharded and len(held) == len(rows) - 1
    every = {(lang, g) for _, lang, text in rows if lang != "xx" for g in quality.n_grams([text], quality.ids_table(letters))[0].tolist()}
    assert joined == [len(every)]


# ---------------------------------------------------------------- 3


def brute_chats(rows, keep=3):
    nodes = {}
    for tree, i, parent, role, text, score in rows:
        if tree is not None and i is not None:
            nodes.setdefault((tree, i), []).append((parent is not None, parent or 0, role or "", text or "", score or 0.0, parent))
    best = {k: min(v) for k, v in nodes.items()}
    children = defaultdict(list)
    for (t, i), v in best.items():
        if v[5] is not None and (t, v[5]) in best:
            children[t, v[5]].append(i)
    out = []
    by = defaultdict(list)

    def walk(t, i, path):
        path = [*path, i]
        if not children[t, i]:
            score = sum(best[t, x][4] for x in path) / len(path)
            by[t].append((-score, -len(path), path[-1], path))
        for c in children[t, i]:
            walk(t, c, path)

    for (t, i), v in best.items():
        if v[5] is None or (t, v[5]) not in best:
            walk(t, i, [])
    for t, paths in by.items():
        for rank, (s, n, leaf, path) in enumerate(sorted(paths)[:keep], 1):
            out.append((t, rank, leaf, -n, round(-s, 9), "".join(f"<|{best[t, x][2]}|>\n{best[t, x][3]}\n" for x in path)))
    return sorted(out)


def test_reply_trees(spark):
    rng = random.Random(4)
    rows = [(1, 0, None, "user", "hi", 1.0)] + [(1, i, rng.randrange(i), rng.choice(["user", "bot"]), f"m{i}", float(rng.randrange(5))) for i in range(1, 40)]
    rows += [(2, 5, 99, "user", "orphan", 2.0), (2, 6, 5, None, None, None), (3, 1, 2, "a", "cycle", 1.0), (3, 2, 1, "b", "cycle", 1.0), (None, 1, None, "a", "x", 1.0), (4, None, None, "a", "x", 1.0), (5, 1, None, "a", "one", 1.0), (5, 2, None, "a", "two", 1.0), (5, 3, None, "a", "three", 1.0), (5, 4, None, "a", "four", 1.0)]
    rows += [(7, 1, None, "a", "t", 1.0), (7, 1, None, "a", "s", 5.0), (7, 2, 1, "b", "u", 0.5), (7, 2, 1, "b", "u", 9.0), (7, 3, 1, "b", LONG, 2.0)]
    rows += [(6, 1, None, "a", "", 0.0)] + [(6, i, i - 1, "b", f"deep{i}", 1.0) for i in range(2, 30)]
    forest = table(spark, rows, "tree long, id long, parent long, role string, text string, score double, rank int, path string")
    found = [(r["conv_id"], r["rank"], r["leaf"], r["turns"], round(r["score"], 9), r["chat"]) for r in chat.conversations(forest).collect()]
    assert sorted(found) == brute_chats(rows)
    assert chat.conversations(forest.limit(0)).isEmpty()


def test_messages_of_turns(spark):
    rows = [(1, 0, "user", "a b a"), (1, 1, "bot", "x"), (1, 2, "bot", "y z"), (1, 3, "user", None), (1, 3, "user", ""), (None, 1, "user", "q"), (2, 7, None, "r")]
    found = {(r["tree"], r["id"]): (r["parent"], r["score"]) for r in chat.messages(table(spark, rows, "conv_id long, turn long, role string, text string, id int")).collect()}
    assert found == {(1, 0): (None, 2.0), (1, 1): (0, 1.0), (1, 2): (0, 2.0), (1, 3): (2, 0.0), (2, 7): (None, 1.0)}


# ---------------------------------------------------------------- 4


def brute_pack(lengths, capacity, most):
    """Open bins as a list: tightest fit, ties by the time the bin came to its free space."""
    out, open_, bins, clock = [], [], 0, 0
    for doc, n in lengths:
        full, rest = divmod(n, capacity)
        for k in range(full):
            out.append((bins, 0, doc, k * capacity, capacity))
            bins += 1
        if not rest:
            continue
        fits = [b for b in open_ if b[1] >= rest]
        if fits:
            b = min(fits, key=lambda b: (b[1], b[3]))
        else:
            if len(open_) >= most:
                open_.remove(min(open_, key=lambda b: (b[1], b[3])))
            b = [bins, capacity, 0, 0]
            bins += 1
            open_.append(b)
        out.append((b[0], b[2], doc, full * capacity, rest))
        clock += 1
        b[1], b[2], b[3] = b[1] - rest, b[2] + 1, clock
        if not b[1]:
            open_.remove(b)
    return out


@pytest.mark.parametrize("capacity, most", [(10, 1), (32, 4), (64, 8)])
def test_packer(capacity, most):
    rng = random.Random(capacity)
    lengths = [(i, rng.choice([1, 2, 3, capacity, capacity + 1, 3 * capacity, rng.randrange(1, 2 * capacity)])) for i in range(500)]
    packer = packing.Packer(capacity, most)
    found = [(b, slot, doc, start, length) for doc, n in lengths for b, slot, start, length in packer.add(n)]
    assert found == brute_pack(lengths, capacity, most)


def test_packed_documents(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 200))) for i in range(60)] + [(7, "again"), (7, "again"), *ODD]
    out = packing.packed_documents(table(spark, rows), capacity=128, open_bins=4, shard_tokens=2000).collect()
    bpe = tokenizer(DEFAULT_RANKS)
    need = Counter()
    for i, t in rows:
        if i is not None and t:
            need[i] += len(encode(bpe, t)) + 1
    got, filled = Counter(), Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
        filled[r["shard"], r["bin"]] += r["length"]
    assert got == need and max(filled.values()) <= 128
    assert packing.packed_documents(table(spark, [])).isEmpty()


# ---------------------------------------------------------------- 5


def test_toxicity_on_held_out(spark):
    rng = random.Random(6)
    bad = ["vile", "slur", "filth", "scum"]
    toxic = lambda: " ".join(rng.sample(prose(rng, 40).split() + rng.choices(bad, k=4), 44))
    rows = [(i, toxic()) for i in range(120)] + [(1000 + i, prose(rng, rng.choice([5, 40, 400]))) for i in range(600)]
    rows = [*rows, *ODD, rows[0]]
    labels = table(spark, [(i, 0, 1) for i in range(60)] + [(1000 + i, 1, 0) for i in range(240)] + [(1, 0, None), (None, 1, 1), (1, 1, 0), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    found = {r["doc_id"] for r in toxicity.toxic_documents(docs, labels).collect()}
    held_out, clean = set(range(60, 120)), {i for i, _ in rows if i and i >= 1000}
    assert len(found & held_out) >= 57 and len(found & clean) <= 3 and not found & {900, 901, 902, 903}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - found
    assert toxicity.toxic_documents(docs, labels.limit(0)).isEmpty() and toxicity.without_toxic(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.toxic_documents(docs.limit(0), labels).isEmpty()


def brute_risk(positive, unlabelled, w, b, prior):
    """(pi R_p(+), R_u(-) - pi R_p(-)) with the logistic loss, document by document."""
    score = lambda s: b + sum(w[i] for i in s)
    loss = lambda z: math.log1p(math.exp(-z))
    mean = lambda values: sum(values) / len(values)
    return prior * mean([loss(score(s)) for s in positive]), mean([loss(-score(s)) for s in unlabelled]) - prior * mean([loss(-score(s)) for s in positive])


@pytest.mark.parametrize("bias", [-2.0, 0.5])
def test_risk_and_gradient(bias):
    """Against sums over documents, and the gradient against differences; below 0 that of the negatives' part is reversed."""
    rng = np.random.default_rng(7)
    positive, unlabelled = ([rng.choice(12, rng.integers(1, 6), replace=False).astype(np.int32) for _ in range(n)] for n in (30, 50))
    signs = set()
    for prior in (0.2, 0.9):
        w = rng.random(12)
        if prior == 0.9:  # the positives' features speak, so that the negatives' part falls below 0
            unlabelled = [s[:1] % 3 for s in unlabelled]
            w[:3] = 0
        value, negative, g, gb = toxicity.risk(toxicity.Bags(positive), toxicity.Bags(unlabelled), w, bias, prior)
        first, second = brute_risk(positive, unlabelled, w, bias, prior)
        assert value == pytest.approx(first + max(0, second)) and negative == pytest.approx(second)
        signs.add(second >= 0)
        step = (lambda w, b: sum(brute_risk(positive, unlabelled, w, b, prior))) if second >= 0 else (lambda w, b: -brute_risk(positive, unlabelled, w, b, prior)[1])  # noqa: B023
        for i in range(12):
            e = np.eye(12)[i] * 1e-5
            assert g[i] == pytest.approx((step(w + e, bias) - step(w - e, bias)) / 2e-5, abs=1e-6)
        assert gb == pytest.approx((step(w, bias + 1e-5) - step(w, bias - 1e-5)) / 2e-5, abs=1e-6)
    assert signs == {True, False}


def test_fit_weighs_what_speaks_for_toxicity():
    rng = np.random.default_rng(7)
    clean = [rng.integers(0, 50, 8).astype(np.int32) for _ in range(120)]
    toxic = [np.append(rng.integers(0, 50, 8), 77).astype(np.int32) for _ in range(40)]
    model = toxicity.fit(toxic[:20], toxic[20:] + clean, 0.14)
    assert (model.values > 0).all() and model.weights[77] == model.weights.max() > -model.bias > 0
    assert not len(toxicity.fit([], clean, 0.1).values) and not len(toxicity.fit(toxic, [], 0.1).values)


# ---------------------------------------------------------------- 6


def test_integral_image_filters():
    rng = np.random.default_rng(8)
    samples = fingerprint.render(rng.normal(0, 0.2, 40))
    image = fingerprint.chroma(samples, fingerprint.RATE)
    got = fingerprint.fingerprint(samples)
    for at in (0, len(got) // 2, len(got) - 1):
        bits = 0
        for kind, p, c, t in fingerprint.FILTERS:
            box = lambda t0, t1, p0, p1: image[at + t0 : at + t1, p0:p1].sum()  # noqa: B023, E731
            whole = box(0, t, p, p + c)
            if kind == 0:
                a, b = whole, (box(0, t, 0, 12) - whole) * c / (12 - c)
            elif kind == 1:
                a, b = box(0, t // 2, p, p + c), box(t // 2, t, p, p + c)
            elif kind == 2:
                a, b = box(0, t, p, p + c // 2), box(0, t, p + c // 2, p + c)
            elif kind == 3:
                a = box(0, t // 2, p, p + c // 2) + box(t // 2, t, p + c // 2, p + c)
                b = whole - a
            elif kind == 4:
                a = box(t // 3, 2 * (t // 3), p, p + c)
                b = (whole - a) / 2
            else:
                a = box(0, t, p + c // 3, p + 2 * (c // 3))
                b = (whole - a) / 2
            level = sum(math.log((1 + a) / (1 + b)) >= x for x in fingerprint.LIMITS)
            bits = bits << 2 | int(fingerprint.GRAY[level])
        assert bits == int(got[at])


def brute_alignments(prints, queries):
    """{(query, id): (offset, overlap, votes, error)} over every pair at every offset."""
    out = {}
    for i in queries:
        for j in prints:
            a, b, ranks = prints[i], prints[j], []
            for offset in range(-len(b), len(a) + 1) if i != j else ():
                error, n = fingerprint.bit_error(a, b, offset)
                if error <= fingerprint.MAX_ERROR and n >= fingerprint.LEAST_OVERLAP:
                    votes = sum(int(a[t + o] == b[t]) for o in (offset - 1, offset, offset + 1) for t in range(len(b)) if 0 <= t + o < len(a))
                    ranks.append((votes, -error, -abs(offset), offset, n))
            if ranks:
                votes, error, _, offset, n = max(ranks)
                out[i, j] = offset, n, votes, pytest.approx(-error)
    return out


def test_search(spark):
    rng = np.random.default_rng(9)
    base = fingerprint.render(rng.normal(0, 0.2, 64))
    other = [fingerprint.render(rng.normal(0, 0.2, 64)) for _ in range(6)]
    shift = 8 * fingerprint.HOP
    noisy = np.clip(base + rng.normal(0, 0.003, len(base)), -1, 1)
    sounds = {1: base, 2: base, 3: base[shift:], 4: noisy, 60: np.zeros(16000), 61: np.zeros(20000), 62: np.zeros(16000), **{10 + i: x for i, x in enumerate(other)}, 53: base[:100], 54: np.zeros(4000)}
    media = [(i, fingerprint.wav(x)) for i, x in sounds.items()] + [(None, fingerprint.wav(base)), (50, None), (51, b""), (52, b"no sound"), (1, fingerprint.wav(base)), (3, fingerprint.wav(base[shift:])), (3, fingerprint.wav(other[0]))]
    prints = {i: fingerprint.fingerprint(*fingerprint.pcm(fingerprint.wav(x))) for i, x in sounds.items()}
    prints[3] = min(prints[3], fingerprint.fingerprint(*fingerprint.pcm(fingerprint.wav(other[0]))), key=lambda f: f.astype("<u4").tobytes())
    first = {i: min(j for j, g in prints.items() if f.tobytes() == g.tobytes()) if len(f) else None for i, f in prints.items()}
    single = {i: f for i, f in prints.items() if first[i] == i}
    for divisor in (1, 2, 7):
        aligned = brute_alignments(single, {first[i] for i in prints if i % divisor == 0} - {None})
        found = fingerprint.searched(table(spark, media, "id long, media binary, fingerprint string, class_id string, asked int"), F.col("id") % divisor == 0).collect()
        assert {(r["id"], r["class_id"], bytes(r["fingerprint"])) for r in found} == {(i, first[i], f.astype("<u4").tobytes()) for i, f in prints.items()}
        assert {(r["id"], r["other"]): (r["offset"], r["overlap"], r["votes"], r["error"]) for r in found if r["other"] is not None} == aligned
        assert len(found) == len(prints) - len({i for i, _ in aligned}) + len(aligned)
    assert fingerprint.searched(table(spark, [], "id long, media binary"), F.col("id") % 2 == 0).isEmpty()


def test_alignment_misses_no_pair(spark):
    """Against every pair at every offset, up to the greatest error and with short overlaps."""
    rng = np.random.default_rng(12)
    rows, prints = [], []
    for k in range(12):
        base = fingerprint.render(rng.normal(0, 0.2, 64))
        noisy = [np.clip(base + rng.normal(0, s, len(base)), -1, 1) for s in (0.3, 0.4, 0.5)]
        for sound in (base, *noisy, base[int(8.25 * fingerprint.HOP) :], base[int(30.5 * fingerprint.HOP) :]):
            prints.append(fingerprint.fingerprint(sound))
            if len(prints) % 3 == 0:
                prints[-1] = prints[-1][rng.integers(0, 4) :][:22]
    rows = [(i, bytearray(f.astype("<u4").tobytes())) for i, f in enumerate(prints)]
    expected = brute_alignments(dict(enumerate(prints)), range(len(prints)))
    found = {(r["query"], r["id"]): (r["offset"], r["overlap"], r["votes"], r["error"]) for r in fingerprint.alignments(spark.createDataFrame(rows, "id long, fingerprint binary")).collect()}
    assert len(expected) > 120 and found == expected


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("chunk, overlap", [(256, 32), (1000, 64), (64, 16)])
def test_token_counts(spark, chunk, overlap):
    rng = random.Random(10)
    odd = "".join(rng.choice("ab 1é漢\n\t.'s🙂  ") for _ in range(3000))
    rows = [(1, prose(rng, 900)), (2, odd), (3, "a" * 700 + " b" * 300), (4, " " * 900 + "x"), (5, "don't we'll " * 200), (6, "short"), (6, "short"), (6, "other one"), (7, "漢" * 1500), *ODD]
    bpe = tokenizer(DEFAULT_RANKS)
    expected = {(i, len(encode(bpe, t))) for i, t in rows if i is not None and t is not None}
    found = [tuple(r) for r in token_counts.token_counts(table(spark, rows), chunk=chunk, overlap=overlap).collect()]
    assert set(found) == expected and len(found) == len(expected)
    assert token_counts.token_counts(table(spark, [])).isEmpty()


# ---------------------------------------------------------------- 8


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:])


def brute_lines(rows, least=line_dedup.MIN_CHARS):
    lines = sorted({(d, n, x.strip(line_dedup.BLANKS).lower()) for d, t in rows if d is not None and t is not None for n, x in enumerate(t.split("\n")) if len(x.strip(line_dedup.BLANKS)) >= least})
    out = set()
    for d, n, x in lines:
        same = min((d2, n2) for d2, n2, y in lines if y == x)
        near = min([(d2, n2) for d2, n2, y in lines if y != x and distance_at_most_one(x, y)], default=same)
        kept = min(same, near)
        if kept != (d, n):
            out.add((d, n, *kept, int(near < same)))
    return out


def line_rows():
    rng = random.Random(11)
    base = [prose(rng, 8) for _ in range(12)]

    def edited(x):
        i = rng.randrange(len(x))
        return rng.choice([x[:i] + x[i + 1 :], x[:i] + "q" + x[i:], x[:i] + "z" + x[i + 1 :], x, x.upper(), "  " + x + "\t"])

    rows = [(i, "\n".join(edited(rng.choice(base)) if rng.random() < 0.6 else prose(rng, rng.randrange(1, 9)) for _ in range(rng.randrange(1, 7)))) for i in range(30)]
    return rows + [(3, rows[3][1]), (4, rows[5][1]), (50, "x" * 5000), (51, "x" * 5001), (52, "x" * 5003), (53, "ab" * 30), (54, "ba" * 30), *ODD]


def test_line_dedup(spark):
    rows = line_rows()
    docs = table(spark, rows)
    found = line_dedup.repeated_lines(docs)
    assert {tuple(r) for r in found.collect()} == brute_lines(rows) and found.count() == len(brute_lines(rows))
    assert line_dedup.repeated_lines(docs.limit(0)).isEmpty()


def without_lines(rows):
    gone = defaultdict(set)
    for d, n, *_ in brute_lines(rows):
        gone[d].add(n)
    real = {(d, n): None for d, n in ((d, n) for d in gone for n in gone[d])}
    out = []
    for d, t in rows:
        if d not in gone or t is None:
            out.append((d, t))
            continue
        kept = "\n".join(x for n, x in enumerate(t.split("\n")) if not ((d, n) in real and len(x.strip(line_dedup.BLANKS)) >= line_dedup.MIN_CHARS))
        if kept.strip(line_dedup.BLANKS + "\n"):
            out.append((d, kept))
    return out


def test_without_repeated_lines(spark):
    rows = [r for r in line_rows() if r[0] not in (3, 4)]
    docs = table(spark, [(*r, "en", "s", 5) for r in rows])
    out = line_dedup.without_repeated_lines(docs)
    assert out.schema == docs.schema
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(without_lines(rows), key=repr)


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [2, 3])
def test_line_dedup_with_more_edits(spark, most):
    rng = random.Random(21)
    rows = []
    for i in range(60):
        line = rng.choice([prose(rng, 6), "é漢🙂" * 9, "ab" * rng.randrange(12, 15)]) if i % 5 == 0 else line
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(line))
            line = rng.choice([line[:at] + line[at + 1 :], line[:at] + "q" + line[at:], line[:at] + "z" + line[at + 1 :]])
        rows.append((i, line + "\nshort"))
    lines = [(i, 0, t.split("\n")[0]) for i, t in rows if len(t.split("\n")[0]) >= line_dedup.MIN_CHARS]
    expected = set()
    for k, (i, n, x) in enumerate(lines):
        near = [(j, m, edits_between(x, y)) for j, m, y in lines[:k]]
        near = [r for r in near if r[2] <= most]
        if near:
            expected.add((i, n, *near[0]))
    found = [tuple(r) for r in line_dedup.repeated_lines(table(spark, rows), max_edits=most).collect()]
    assert set(found) == expected and len(found) == len(expected) and {r[4] for r in found} >= {most}


# ---------------------------------------------------------------- 9


def test_checksums():
    assert records.crc32c([b"123456789", b"", b"a", b"\0" * 32]).tolist() == [0xE3069283, 0, 0xC1D04330, 0x8A9136AA]
    rng = np.random.default_rng(12)
    many = [rng.bytes(int(n)) for n in rng.integers(0, 2000, 60)]
    assert records.crc32c(many).tolist() == [records._few(x) for x in many]


def slow_crc32c(data):
    """Bit by bit, from the polynomial."""
    c = 0xFFFFFFFF
    for byte in data:
        c ^= byte
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_records_by_another_reader(spark, tmp_path):
    """The files from their first byte to the last, without the index and the operator's own functions."""
    rows = [(i, prose(random.Random(i), i)) for i in range(12)] + [(5, "é漢🙂"), *ODD]
    index = records.write_records(table(spark, rows).repartition(3), f"file://{tmp_path}/r").collect()
    mask = lambda c: (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    places, decoded = {(r["file"], r["offset"]): r for r in index}, []
    for file in {r["file"] for r in index}:
        data, at = (tmp_path / "r/data" / file).read_bytes(), 0
        while at < len(data):
            size = int.from_bytes(data[at : at + 8], "little")
            body = data[at + 12 : at + 12 + size]
            assert int.from_bytes(data[at + 8 : at + 12], "little") == mask(slow_crc32c(data[at : at + 8]))
            assert int.from_bytes(data[at + 12 + size : at + 16 + size], "little") == mask(slow_crc32c(body)) == places[file, at]["checksum"]
            assert places[file, at]["bytes"] == size + 16 and places[file, at]["n_tokens"] == size // 2
            decoded.append((places[file, at]["doc_id"], [int.from_bytes(body[k : k + 2], "little") for k in range(0, size, 2)]))
            at += size + 16
        assert at == len(data)
    bpe = tokenizer(DEFAULT_RANKS)
    assert len(decoded) == len(index) and sorted(decoded) == sorted((i, bpe.encode_ordinary(t)) for i, t in rows if i is not None and t is not None)


def test_records_round_trip(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randrange(1, 300))) for i in range(40)] + [(3, "é漢🙂"), (3, "é漢🙂"), *ODD]
    folder = f"file://{tmp_path}/r"
    index = records.write_records(table(spark, rows), folder)
    bpe = tokenizer(DEFAULT_RANKS)
    expected = sorted((i, encode(bpe, t).tolist()) for i, t in rows if i is not None and t is not None)
    back = records.read_records(index.orderBy(F.rand(1)), folder)
    assert sorted((r["doc_id"], r["ids"]) for r in back.collect()) == expected
    r = index.where("n_tokens > 5").first()
    with open(tmp_path / "r/data" / r["file"], "r+b") as f:
        f.seek(r["offset"] + 14)
        b = f.read(1)
        f.seek(r["offset"] + 14)
        f.write(bytes([b[0] ^ 1]))
    with pytest.raises(Exception, match="damaged"):
        records.read_records(index, folder).count()
    empty = records.write_records(table(spark, []), f"file://{tmp_path}/e")
    assert empty.isEmpty() and records.read_records(empty, f"file://{tmp_path}/e").isEmpty()


# ---------------------------------------------------------------- 10


def grams(text, n=3):
    w = words_of(text or "")
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def brute_pairs(rows, threshold=jaccard_join.THRESHOLD):
    classes = defaultdict(set)
    for d, t in rows:
        if d is not None and grams(t):
            classes[grams(t)].add(d)
    first = {s: min(ids) for s, ids in classes.items()}
    out = {(first[s], d): 1.0 for s, ids in classes.items() for d in ids if d != first[s]}
    sets = list(classes)
    for i, a in enumerate(sets):
        for b in sets[:i]:
            j = len(a & b) / len(a | b)
            if j >= threshold and first[a] != first[b]:
                k = tuple(sorted((first[a], first[b])))
                out[k] = max(j, out.get(k, 0))
    return out


def near_rows():
    rng = random.Random(14)
    base = [prose(rng, rng.choice([1, 2, 5, 30, 120])) for _ in range(25)]

    def changed(t):
        w = t.split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = prose(rng, 1)
        return " ".join(w) + rng.choice(["", "!", " und"])

    return [(i, changed(rng.choice(base))) for i in range(220)] + [(300 + i, base[3] + " ." * i) for i in range(40)] + [(600, prose(rng, 5000)), *ODD, (901, "")]


def brute_links(rows, threshold=jaccard_join.THRESHOLD):
    """(doc_id, class_id, links) of every document and different text."""
    entries = sorted({(d, grams(t)) for d, t in rows if d is not None and grams(t)}, key=lambda e: (e[0], sorted(e[1])))
    sets = sorted({s for _, s in entries}, key=sorted)
    close = {s: [t for t in sets if t != s and len(s & t) / len(s | t) >= threshold] for s in sets}
    holders = Counter(s for _, s in entries)
    low = {s: min(d for d, t in entries if t == s) for s in sets}
    for _ in sets:
        low = {s: min([low[s], *(low[t] for t in close[s])]) for s in sets}
    return Counter((d, low[s], holders[s] - 1 + sum(holders[t] for t in close[s])) for d, s in entries)


@pytest.mark.parametrize("points, grams, hot", [(8_000, 1 << 20, 1 << 22), (20, 1 << 20, 1 << 22), (8_000, 900, 1 << 22), (30, 2000, 3)])
def test_jaccard_join(spark, monkeypatch, tmp_path, points, grams, hot):
    """In one task a region, in cells by points and by n-grams, and with blocks too large to gather."""
    for name, value in (("REGION_POINTS", points), ("REGION_GRAMS", grams), ("HOT_CLASSES", hot)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = [*near_rows(), (5, "another text of an id that has one"), (5, "another text of an id that has one")]
    table(spark, rows).drop("`line.no`").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    if hot == 3:
        assert len(jaccard_join.hot_grams(docs.select("doc_id", "text").where("text is not null and doc_id is not null"), 3, 0.6, 0.2)) > 10
    found = jaccard_join.near_duplicates(docs)
    assert Counter(tuple(r) for r in found.collect()) == brute_links(rows)
    assert jaccard_join.near_duplicates(docs.limit(0)).isEmpty()


def test_fewest_shared():
    """No close pair shares fewer leading n-grams than either set's bound, and unrelated sets need a third of theirs to be points."""
    for threshold, shared in ((0.6, 0.2), (0.7, 0.2), (0.5, 0.5), (0.3, 0.6)):
        lead = [jaccard_join._leading(m, threshold, shared) for m in range(301)]
        least = [jaccard_join.fewest_shared(m, threshold, shared) for m in range(301)]
        for x in range(1, 301):
            for y in range(max(1, math.ceil(threshold * x - 1e-9)), x + 1):
                both = next(o for o in range(math.floor(threshold * x), y + 1) if o / (x + y - o) >= threshold - 1e-9)
                assert min(both - x + lead[x], both - y + lead[y]) >= max(1, least[x], least[y]), (x, y)
    assert jaccard_join.fewest_shared(300, 0.6, 0.2) == 60


def test_regions_are_exact():
    rng = np.random.default_rng(15)
    base = [np.unique(rng.integers(0, 4000, 60)) for _ in range(20)]
    sets = [np.unique(np.where(rng.random(len(b)) < rng.choice([0, 0.05, 0.2]), rng.integers(0, 4000, len(b)), b)) for b in base for _ in range(20)]
    sets += [np.unique(np.append(base[0][: 30 + i % 30], 5000 + i % 7)) for i in range(60)]
    similar = {(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) if (both := len(np.intersect1d(a, sets[j]))) / (len(a) + len(sets[j]) - both) >= 0.7}
    assert jaccard_join.close_pairs(sets, 0.7) == similar
    # two sides, weights, and pairs that another region has
    side, weight = np.arange(len(sets)) % 3 == 0, rng.integers(1, 5, len(sets))
    earlier = [np.array([i % 5] if i % 2 else [], np.int64) for i in range(len(sets))]
    region = jaccard_join.Region(sets, 0.7, weight, earlier, side)
    region.join(np.arange(len(sets)))
    left = [(i, j) for i, j in similar if side[i] != side[j] and not (i % 2 and j % 2 and i % 5 == j % 5)]
    links = np.zeros(len(sets), np.int64)
    for i, j in left:
        links[i] += weight[j]
        links[j] += weight[i]
    assert region.links.tolist() == links.tolist() and region.inferred > 0
    label = {}
    for i, j in sorted(left):
        label.setdefault(i, i), label.setdefault(j, j)
    for _ in label:
        for i, j in left:
            label[i] = label[j] = min(label[i], label[j])
    assert all(region.label[i] == label.get(i, i) for i in range(len(sets)))


def groups(pairs):
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    return {x for x in label if find(x) != x}


def test_one_of_each_group(spark):
    rows = near_rows()
    docs = table(spark, rows)
    out = jaccard_join.one_of_each_group(docs)
    gone = groups(brute_pairs(rows))
    assert out.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(str(i) for i, _ in rows if i not in gone)
    assert jaccard_join.one_of_each_group(docs.limit(0)).isEmpty()


def test_finished_tables_leave_no_files(spark):
    """Shuffle files and tables of the pipeline's stage don't stay until the driver happens to collect garbage."""

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(files.apply(i).getName()) for i in range(files.size()) if "shuffle" in files.apply(i).getName()}

    def tables():
        at = f"{shared_dir(spark)}/sluice-{spark.sparkContext.applicationId}".removeprefix("file://").removeprefix("file:")
        return {x.rpartition("-")[0] for x in set(os.listdir(at)) - there} if os.path.isdir(at) else set()

    there, before = set(), shuffled()
    df = written(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "sevenths")
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and df.count() == 7 and spark.conf.get(SHUFFLE_CLEANUP, None) is None
    there = set(os.listdir(os.path.dirname(df._written_at.removeprefix("file://").removeprefix("file:"))))
    out = jaccard_join.one_of_each_group(table(spark, near_rows()))
    assert out.count() and tables() == {"near-duplicates"}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["id"]: r["label"] for r in jaccard_join.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}

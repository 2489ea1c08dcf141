"""The free-style operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import chat, components, jaccard_join, packing, quality_classifier, suffix_dedup, toxicity
from millrace.llm.suffix_array import permuted_lcp, suffix_array

MODEL = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def frame(spark, texts, nulls=True):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    if nulls:
        rows.append((None, texts[0], None, None, None))
    return spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit("k"), "n": F.lit(1), "doc": F.lit("d")}).repartition(3)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- packing -----------------------------------------------------------------------------------


def test_packing_covers_every_token_without_padding(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(1, 900)) for _ in range(60)] + [
        "", None, "<|endoftext|> it's x\x1cy É́ 😀 İ", prose(rng, 9000), "a" * 5000, "  \n ",
    ]
    rows = packing.pack(frame(spark, texts), MODEL, block_tokens=20_000).collect()
    tokenizer, by, sequences = Tokenizer.from_file(MODEL), defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in [*enumerate(texts), (None, texts[0])]:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0


def test_assignment_balances_cost():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 3000) for _ in range(800)]
    pieces, fills = packing.assign(lengths)
    costs = [0.0] * len(fills)
    for _, _, n, s, _ in pieces:
        costs[s] += packing.cost(n)
    full = [c for c, f in zip(costs, fills, strict=True) if f == 4096]
    arrival = [sum(packing.cost(n) for n in lengths[i : i + 3]) for i in range(0, 600, 3)]
    assert max(full) / min(full) < max(arrival) / min(arrival)
    assert packing.assign([]) == ([], [])


def brute_assign(lengths, capacity):
    """Every remainder, longest first, to the sequence of least cost with room; else cut into the cheapest."""
    whole = [(d, at, capacity) for d, n in enumerate(lengths) for at in range(0, n - capacity + 1, capacity)]
    sequences = [[x] for x in whole]
    rest = sorted(((n % capacity, d) for d, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1]))
    full, tail = divmod(sum(n for n, _ in rest), capacity)
    sizes = [capacity] * len(whole) + [capacity] * full + [1 << b for b in range(20, -1, -1) if tail >> b & 1]
    sequences += [[] for _ in sizes[len(whole) :]]
    cost = lambda s: sum(packing.cost(x[2]) for x in s)
    last = len(whole) + full
    for n, d in rest:
        at = lengths[d] - n
        while n:
            room = [sizes[i] - sum(x[2] for x in s) for i, s in enumerate(sequences)]
            some = [i for i in range(last) if room[i]]
            if not some:
                last += 1
                continue
            fit = [i for i in some if room[i] >= n] or some
            i = min(fit, key=lambda i: (cost(sequences[i]), i))
            take = min(n, room[i])
            sequences[i].append((d, at, take))
            n, at = n - take, at + take
    return sorted((*x, i) for i, s in enumerate(sequences) for x in s)


def test_assignment_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([16, 64])
        lengths = [rng.randrange(1, capacity * 2) for _ in range(rng.randrange(40))]
        pieces, _ = packing.assign(lengths, capacity)
        assert sorted((d, at, n, s) for d, at, n, s, _ in pieces) == brute_assign(lengths, capacity)


def test_packing_of_no_rows_and_of_repeated_ids(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), MODEL).count() == 0
    rows = packing.pack(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d")], "doc_id bigint, text string"), MODEL).collect()
    assert sum(r.length for r in rows) == 3 * 1 + sum(len(Tokenizer.from_file(MODEL).encode(t, add_special_tokens=False).ids) for t in ("a b c", "a b c", "d"))


# --- chat --------------------------------------------------------------------------------------

CONVERSATIONS = {
    1: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")],
    2: [("assistant", ""), ("assistant", "a\\"), ("assistant", "###")],
    3: [("system", None), (None, "x\n</turn>\n### user\ny"), ("assistant", "######\\\\</turn>\\")],
    4: [("a\nb ###", "😀 <|endoftext|>"), ("assistant", "é")],
}


def test_chat_round_trips(spark):
    rows = [(c, t, r, x, "more") for c, turns in CONVERSATIONS.items() for t, (r, x) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, ids string").repartition(4)
    got = {r.conv_id: r for r in chat.digest(df, RANKS, public_tokenizers.PATTERN).collect()}
    full = {r.conv_id: r for r in chat.format_conversations(df, RANKS, public_tokenizers.PATTERN).collect()}
    for c, turns in CONVERSATIONS.items():
        turns = [(r or "", x or "") for r, x in turns]
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert chat.parse(full[c].formatted) == turns and len(full[c].formatted) == r.formatted_chars
        assert len(full[c].ids) == len(full[c].loss) == r.n_tokens
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digest(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# --- Jaccard join ------------------------------------------------------------------------------


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[i : i + 1] = [[f"e{rng.randrange(10**6)}"], [], [words[i], f"i{rng.randrange(10**6)}"]][kind]
    return words


def near_texts(rng):
    line = prose(rng, 18)
    texts = [prose(rng, 120) + " " + line for _ in range(30)]
    for size in (3, 9, 11, 12, 18, 19, 20, 25, 60, 150, 400):
        base = prose(rng, size).split()
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            texts.append(" ".join(edited(rng, base, edits)))
    base = prose(rng, 150).split()
    texts += [" ".join(edited(rng, base, rng.randrange(7))) for _ in range(120)]
    # a chain whose ends do not link
    step = prose(rng, 200).split()
    for i in range(12):
        step = edited(rng, step, 2)
        texts.append(" ".join(step))
    return texts + ["", None, " \t", "One", "one", "one two", "É x y", "é x y", "One TWO three"]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    texts = near_texts(random.Random(seed))
    got = jaccard_join.join_components(frame(spark, texts)).collect()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert len(got) == len(texts) + 1 and found.pop(None)[0] == len(shingles(texts[0]))
    assert [found[i] for i in range(len(texts))] == brute_components(texts)


def test_jaccard_light_and_heavy_agree(spark, monkeypatch):
    texts = near_texts(random.Random(3))
    for limit in (8, 17):
        monkeypatch.setattr(jaccard_join, "light_limit", lambda counters, sizes, rule, limit=limit: limit)
        got = jaccard_join.join_components(frame(spark, texts, nulls=False)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, *x) for i, x in enumerate(brute_components(texts))]


def test_boundary_is_the_least_cost():
    """Long lists make digests cheaper, short ones the scan; and the boundary is where the sum is least."""
    rare, common = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
    rare[:300], common[:300] = 1, 500
    sizes = {n: 100 for n in range(1, 30)}
    rule = jaccard_join.CONTRACT
    assert jaccard_join.light_limit(common, sizes, rule) == rule.max_light
    assert jaccard_join.light_limit(rare, sizes, rule) == rule.least_light - 1
    assert jaccard_join.light_limit(rare * 0, {}, rule) == rule.max_light


def test_jaccard_empty(spark):
    assert jaccard_join.join_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 230)] + [(5, 5)]
    rows = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.root for r in rows if r.node < 150 and r.node >= 100} == {100}
    assert {r.root for r in rows if r.node >= 200} == {7}


# --- suffix arrays -----------------------------------------------------------------------------


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(150):
        t = np.concatenate([rng.integers(1, rng.integers(2, 6), rng.integers(1, 60)), [0]]).astype(np.uint16)
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        lcp = permuted_lcp(t, sa, np.array([0]), 400)
        for a, b in zip(sa[1:], sa[:-1], strict=True):
            n = 0
            while t[a + n] == t[b + n]:
                n += 1
            assert lcp[a] == n


def brute_repeats(texts):
    bodies = [(t or "").encode() for t in texts]
    starts = defaultdict(int)
    for b in bodies:
        for i in range(len(b) - 199):
            starts[b[i : i + 200]] += 1
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if starts[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def repeat_texts(rng):
    a, b = prose(rng, 60), prose(rng, 45)
    exact199, exact200 = ("x" + prose(rng, 80))[:199], ("y" + prose(rng, 80))[:200]
    return [
        a, a, prose(rng, 30) + a + prose(rng, 30), a[5:] + "é" * 150, "é" * 150, b + " " + b, "it " * 300, "z" * 900, "z" * 199, "",
        None, exact199 + "!", "?" + exact199, exact200 + "!", "?" + exact200, prose(rng, 400), a[:120] + b + a[120:], "q" * 201,
    ]


@pytest.mark.parametrize("hot", [2_000, 3, 0])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = repeat_texts(random.Random(5))
    got = suffix_dedup.digest(frame(spark, texts, nulls=False)).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == brute_repeats(texts)


def test_suffix_dedup_of_a_common_line(spark, monkeypatch):
    """One line of 260 bytes in the midst of many texts: whole results, and no shard of many pieces."""
    monkeypatch.setattr(suffix_dedup, "HOT", 100)
    sizes = []
    compare = suffix_dedup._compare
    monkeypatch.setattr(suffix_dedup, "_compare", lambda p: (sizes.append(p.groupBy("shard").count().agg(F.max("count")).first()[0]), compare(p))[1])
    rng = random.Random(8)
    line = prose(rng, 80)[:260]
    texts = [f"{prose(rng, 45, 10**9)} {line} {prose(rng, 45, 10**9)}" for _ in range(1500)]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id bigint, text string").repartition(4)
    got = suffix_dedup.digest(df).collect()
    brute = brute_repeats([*texts, texts[0]])
    assert [tuple(r)[1:] for r in sorted(r for r in got if r.doc_id is not None)] == brute[:-1]
    assert [tuple(r)[1:] for r in got if r.doc_id is None] == brute[-1:]
    assert max(x or 0 for x in sizes) <= 100


def test_suffix_dedup_stretches_blocks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 300)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
    texts = repeat_texts(random.Random(6))
    df = frame(spark, texts, nulls=False)
    assert [tuple(r)[1:] for r in sorted(suffix_dedup.digest(df).collect())] == brute_repeats(texts)
    twice = suffix_dedup.digest(df.unionByName(df)).collect()
    assert all(r.n_removed == r.n_bytes or r.n_bytes < 200 for r in twice) and len(twice) == 2 * len(texts)
    assert suffix_dedup.digest(spark.createDataFrame([], SCHEMA)).count() == 0


# --- models ------------------------------------------------------------------------------------

BAD = ["idiot", "moron", "stupid", "worthless", "scum"]


def labelled(spark, n=700):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = prose(rng, 60, 300).replace("w", "word").split()
        words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words]
        if toxic:
            for w in rng.sample(BAD, 2):
                words.insert(rng.randrange(60), w)
        junk = i % 5 == 1
        if junk:
            words = [w + rng.choice(["$$$", "###"]) for w in words]
        rows.append((i, " ".join(words), None, None, None))
        labels.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame(rows + [(None, None, None, None, None), (n, "", None, None, None)], SCHEMA)
    return docs, spark.createDataFrame(labels + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)
    for hidden in ("1d10t", "i d i o t", "m.o.r.o.n", "$tup1d", "scuuuum", "w0rthl3ss"):
        assert model.score(f"the {hidden} of") > model.score("the of"), hidden
    assert all(0 <= r.score <= 1 for r in rows) and toxicity.score(docs, model).count() == 702


def exhaustive(model, span):
    """The least cost of all readings of a span, by trying every one."""

    def least(i, context):
        if i == len(span):
            return 0.0 if context == "^^" else model.cost(context, "$")
        return min(price + least(i + 1, to) for to, price, _ in model.arcs(span, i, context))

    return least(0, "^^")


def cost_of(model, span):
    states = {"^^": 0.0}
    for i in range(len(span)):
        best = {}
        for context, c in states.items():
            for to, price, _ in model.arcs(span, i, context):
                best[to] = min(best.get(to, 1e9), c + price)
        states = best
    return min(c + (0.0 if s == "^^" else model.cost(s, "$")) for s, c in states.items())


def test_viterbi_equals_exhaustive_search():
    rng = random.Random(4)
    texts = ["a bad idiot said it", "the idiot is a moron", "naïve été ß über", "loser trash"] * 20
    model = toxicity.Model(dict(toxicity._counted(texts)))
    for _ in range(300):
        span = "".join(rng.choice("idotmrn10!$a é.-  x") for _ in range(rng.randrange(1, 9)))
        assert cost_of(model, span) == pytest.approx(exhaustive(model, span)), span
    assert model.restore("1d10t") == model.restore("i d i o t") == model.restore("id.iot") == "idiot" and model.restore("id iot") == "idiot"


SYMBOLS = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$", "t": "7", "b": "8", "g": "9"}


def disguised(rng, word):
    kind = rng.randrange(5)
    if kind == 0:
        return "".join(SYMBOLS.get(c, c) for c in word)
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return rng.choice(".-_*~").join(word)
    if kind == 3:
        i = rng.randrange(1, len(word))
        return word[:i] + word[i] * 4 + word[i + 1 :]
    i = rng.randrange(2, len(word) - 1)
    return word[:i] + " " + word[i:]


def test_obfuscated_words_of_held_out_rows(spark):
    """Recall on held-out toxic rows whose words are disguised: at least 0.9, and next to nothing without decoding."""
    docs, labels = labelled(spark)
    model, rng = toxicity.fit(docs, labels), random.Random(12)
    toxic = {r.doc_id for r in labels.collect() if r.toxic == 1}
    held = [r for r in docs.collect() if r.doc_id is not None and r.doc_id < 700 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    hits, plain, n, clean = 0, 0, 0, []
    for r in held:
        if r.doc_id in toxic:
            text = " ".join(disguised(rng, w) if w in BAD else w for w in r.text.split())
            hits += model.score(text) >= 0.5
            plain += model.bias + sum(model.weights.get(w, 0.0) for w in set(text.split())) >= 0
            n += 1
        else:
            clean.append(model.score(r.text) >= 0.5)
    assert n >= 15 and hits >= 0.9 * n and plain <= 0.1 * n and sum(clean) <= 0.02 * len(clean), (n, hits, plain)


def test_skeletons_lose_no_reading(spark):
    """A phrase that whole-token decoding of any run of tokens reads is found through skeletons too."""
    rng = random.Random(6)
    model = toxicity.Model(dict(toxicity._counted(["a bad idiot said it to the moron"] * 40)), {"idiot": 2.0, "moron": 2.0, "bad idiot": 1.0}, -1.0)
    for _ in range(150):
        tokens = [rng.choice(["a", "bad", "said", "it", "mo", "ron", "1", "x9", "!"]) for _ in range(rng.randrange(3))]
        tokens[1:1] = [disguised(rng, rng.choice(["idiot", "moron"]))]
        text = " ".join(tokens)
        parts, read = text.split(" "), set()
        for i in range(len(parts)):
            for j in range(i + 1, min(len(parts), i + 7) + 1):
                span = " ".join(parts[i:j])
                read |= {w for w in ("idiot", "moron") if span.strip("!") and model.restore(span.strip("!")) == w}
        assert read <= model.find(text), text


def test_toxicity_edge_cases(spark):
    docs, labels = labelled(spark, 300)
    model = toxicity.fit(docs, labels)
    rows = [(1, "x " * 60_000 + "1d10t"), (1, "x " * 60_000 + "1d10t"), (None, "idiot"), (2, None), (3, ""), (4, "日本 idiot €")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"score": F.lit(3), "held_out": F.lit("x")})
    got = toxicity.score(df, model).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id == 1}) == 1 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].predicted == by[None].predicted == by[4].predicted == 1 and by[2].score == by[3].score and not by[None].held_out
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.fit(docs.limit(0), labels).weights == {}


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 20)
    model = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.5}


def test_quality_classifier(spark):
    docs, labels = labelled(spark)
    rows = quality_classifier.select(docs, labels).join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
    kept = quality_classifier.keep(docs.withColumns({"n": F.lit("x"), "kept": F.lit(2), "c0": F.lit(3)}), labels)
    assert kept.columns[-3:] == ["n", "kept", "c0"] and kept.filter("doc_id < 700").count() == sum(r.kept for r in rows)
    assert quality_classifier.select(docs, labels.limit(0)).filter("kept").count() == docs.count()
    assert quality_classifier.keep(docs.limit(0), labels).count() == quality_classifier.select(docs.limit(0), labels).count() == 0


def test_quality_ratios_and_draw_against_brute_force(spark):
    """Counts, ratios, weights, noise and the choice of k keys, restated with plain dictionaries."""
    docs, labels = labelled(spark, 120)
    twice = docs.filter("doc_id < 5")
    docs = docs.unionByName(twice).unionByName(spark.createDataFrame([(9000, "word " * 40_000, None, None, None)], SCHEMA))
    grams = lambda t: quality_classifier.features(t or "", quality_classifier.Tokens()).tolist()
    raw, target = defaultdict(int), defaultdict(int)
    good = {r.doc_id for r in labels.collect() if r.doc_id is not None and r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 5}
    seen = set()
    for r in docs.collect():
        for g in grams(r.text):
            raw[g] += 1
            target[g] += r.doc_id in good and r.doc_id not in seen
        seen.add(r.doc_id)
    size, (nt, nr) = quality_classifier.BUCKETS, (sum(target.values()), sum(raw.values()))
    ratio = {g: math.log((target[g] + 1) / (nt + size) / ((raw[g] + 1) / (nr + size))) for g in raw}
    model = quality_classifier.fit(docs, labels)
    assert all(model.ratio[g] == pytest.approx(x) for g, x in ratio.items())
    rows = quality_classifier.select(docs, labels, k=50, seed=7).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        own = grams(texts[r.doc_id])
        weight = sum(ratio[g] for g in own) / len(own) * min(len(own), 100)
        assert r.log_weight == pytest.approx(weight)
        assert r.gumbel_key == pytest.approx(model.slope * weight + quality_classifier.gumbel(7, r.doc_id, texts[r.doc_id]))
    cut = sorted((r.gumbel_key for r in rows), reverse=True)[49]
    assert all(r.kept == (r.gumbel_key >= cut) for r in rows)
    assert len({r.kept for r in rows if r.doc_id == 3}) == 1


def test_draw_follows_the_weights(spark):
    """Inclusion over many seeds is that of sampling without replacement; the draw is no threshold."""
    weights = np.repeat([0.0, 1.0, 2.0], 40)
    texts = [f"t{i}" for i in range(120)]
    k, n, hits, apart = 30, 400, np.zeros(120), 0
    for seed in range(n):
        keys = weights + [quality_classifier.gumbel(seed, i, t) for i, t in enumerate(texts)]
        took = np.argsort(-keys)[:k]
        hits[took] += 1
        apart += set(took.tolist()) != set(range(90, 120))
    share = hits.reshape(3, 40).mean(1) / n
    rng, want = np.random.default_rng(1), np.zeros(3)
    for _ in range(n):
        p = np.exp(weights)
        for _ in range(k):
            i = rng.choice(120, p=p / p.sum())
            p[i] = 0
            want[i // 40] += 1 / n / 40
    assert apart == n and np.allclose(share, want, atol=0.02)
    df = spark.createDataFrame([(i, float(w), float(w) + quality_classifier.gumbel(3, i, t)) for i, (w, t) in enumerate(zip(weights, texts, strict=True))], "doc_id bigint, log_weight double, gumbel_key double")
    kept = [r.doc_id for r in quality_classifier.sampled(df, quality_classifier.Model(np.zeros(1), 1.0, 0.0), 30).filter("kept").collect()]
    assert len(kept) == 30 and 0 < sum(i < 80 for i in kept) < 30


def test_kth_largest(spark):
    values = [float(x % 97) / 7 for x in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 500, 999, 1000):
        assert quality_classifier.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]

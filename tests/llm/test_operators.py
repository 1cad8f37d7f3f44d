"""Each operator against brute force, on tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from veilgauge.llm import ann, components, langid, line_dedup, mixing, packing, quality, queries, sharding, similar, simhash, toxicity, warc

from .conftest import rows


def collected(df):
    return [tuple(r) for r in df.collect()]


# --- 5 sharding ---------------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_gapless_and_whole(docs, shards):
    out = sharding.histogram_sort(docs, shards=shards).select("doc_id", "size", "text_crc32", "shard", "slot", "text").collect()
    assert len(out) == docs.count()
    by = collections.defaultdict(list)
    for r in out:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    for v in by.values():
        assert abs(sum(r["size"] for r in v) - total / shards) <= largest + 0.01 * total


def test_shards_are_as_even_as_the_tolerance(docs):
    some = docs.where("length(text) < 3000")
    out = sharding.histogram_sort(some, shards=4, tolerance=0.01).groupBy("shard").agg(F.sum("size").alias("n"), F.max("size").alias("m")).collect()
    mean = sum(r.n for r in out) / 4
    assert len(out) == 4 and all(abs(r.n - mean) <= 0.02 * mean + 2 * max(x.m for x in out) for r in out)


def test_crowded_cells_are_numbered_in_order(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 4)
    df = spark.createDataFrame([(i, f"text {i % 50 if i % 3 else 0}") for i in range(900)] + [(7, "text 0")] * 3, "doc_id long, text string")
    out = sharding.histogram_sort(df, shards=3)
    h, g = sharding._keys(F.col("text"), F.col("doc_id"))
    rows = sorted((r.shard, r.slot, r.h, r.g) for r in out.select("shard", "slot", h.alias("h"), g.alias("g")).collect())
    assert len(rows) == 903 and [k[2:] for k in rows] == sorted(k[2:] for k in rows)
    for shard in range(3):
        assert [k[1] for k in rows if k[0] == shard] == list(range(sum(k[0] == shard for k in rows)))


def test_heavy_copies_are_split_and_light_ones_stay(spark):
    rng = random.Random(3)
    data = [(i, "the same text again") for i in range(600)] + [(1000 + i, f"text {i} " + "y" * rng.randint(0, 30)) for i in range(900)]
    out = sharding.histogram_sort(spark.createDataFrame(data, "doc_id long, text string"), shards=10).collect()
    sizes = collections.Counter()
    for r in out:
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 10
    assert max(sizes.values()) < 1.03 * mean and min(sizes.values()) > 0.97 * mean


def test_sharding_of_nothing(empty):
    assert sharding.histogram_sort(empty).count() == 0


# --- 3 near-dedup --------------------------------------------------------------------------------


def plain_fingerprint(text, words=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_near_duplicates_against_all_pairs(docs):
    got = collected(simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id"))
    want = [(r[0], plain_fingerprint(r[1])) for r in rows()]
    assert sorted(got, key=str)[0] is not None and collections.Counter((i, f) for i, f, _ in got) == collections.Counter((i, f"{x:016x}") for i, x in want)
    at = roots({x for _, x in want}, lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for i, x in want:
        if i is not None:
            least[at[x]] = min(i, least.get(at[x], i))
    assert all(c == least.get(at[int(f, 16)]) for _, f, c in got)


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:  # many that are close to one another, in a few clusters
        x = rng.choice(sorted(fps))
        fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if rng.random() < 0.9 else x ^ rng.getrandbits(64) & 0xFF)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    edges = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, bucket_pairs=8)
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    want = roots(signed, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups({x: got.get(x, x) for x in signed}) == groups(want)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (5, 5)], "a long, b long")
    got = dict(collected(components.connected_components(edges)))
    assert all(got[i] == 0 for i in range(201)) and got[901] == got[900] == 900


def test_representatives_at_a_similarity_of_four_fifths(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(30)]
    data = [(i, t) for i, t in enumerate(base)]
    for i in range(20):  # one word in 120 changed: a Jaccard similarity of about 0.9
        w = base[0].split()
        w[rng.randrange(len(w))] = "edited"
        data.append((100 + i, " ".join(w)))
    data += [(200, base[1]), (201, base[1]), (200, base[1])]
    kept = simhash.keep_representatives(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))


def test_only_and_nearly_all_pairs_of_four_fifths_are_linked(spark):
    rng = random.Random(12)
    data = []
    for i in range(200):
        w = [f"w{rng.randrange(10**6)}" for _ in range(404)]
        changed = 8 if i % 2 else 9  # of 400 shingles 5 each: similarities of 360 / 440 and 355 / 445
        other = list(w)
        for k in range(changed):
            other[20 + 40 * k] = "edited"
        data += [(i, " ".join(w)), (1000 + i, " ".join(other))]
    kept = {r.doc_id for r in simhash.keep_representatives(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert set(range(200)) <= kept and {1000 + i for i in range(0, 200, 2)} <= kept
    assert sum(1000 + i in kept for i in range(1, 200, 2)) == 0


def test_links_beside_the_least_of_a_band(spark):
    w = [f"w{i}" for i in range(404)]
    chain = []
    for k in range(5):  # neighbours differ in 4 words, the ends in 16
        chain.append((k, " ".join(w)))
        for j in range(4):
            w[10 + 20 * (4 * k + j)] = f"edited{k}"
    kept = simhash.keep_representatives(spark.createDataFrame([chain[i] for i in (2, 0, 4, 1, 3)], "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [0]


def test_candidates_are_close_simhashes_that_share_a_block(spark):
    rng = random.Random(21)
    sets = []
    for size in (4, 5, 12, 40, 200):
        for _ in range(12):
            h = [rng.getrandbits(64) for _ in range(size)]
            sets += [h, [*h, *(rng.getrandbits(64) for _ in range(size // 4))], [*h[: size // 2], *(rng.getrandbits(64) for _ in range(size // 2))]]
    rows, majority = 10**5, lambda h, w, i: 2 * sum(int(x) >> i & 1 for x in similar._mixed(np.array(h, np.uint64), w + 1)[:, w]) > len(h)
    bits, few, many = similar.blocks(rows)
    prints = [similar.signature(np.array(h, np.uint64), similar.words_of(rows)[len(h) <= similar.SHORT]) for h in sets]
    for h, v in list(zip(sets, prints, strict=True))[::17]:
        assert [int(v[w]) >> i & 1 for w in (0, len(v) - 1) for i in range(64)] == [majority(h, w, i) for w in (0, len(v) - 1) for i in range(64)]
    data = [(k, len(h), v.view(np.int64).tolist()) for k, (h, v) in enumerate(zip(sets, prints, strict=True))]
    got = collections.defaultdict(set)
    for r in similar.buckets(spark.createDataFrame(data, "node long, n long, fp array<long>"), rows).collect():
        got[r.key].add(r.node)

    def number(k):
        return int.from_bytes(prints[k].tobytes(), "little") >> 64 * similar.CHECKED

    want = set()
    for a in range(len(sets)):
        for b in range(a):
            shared = min(few if len(sets[k]) > similar.SHORT else many for k in (a, b))
            block = any((number(a) ^ number(b)) >> bits * j & (1 << bits) - 1 == 0 for j in range(shared))
            if block and sum(bin(int(prints[a][i]) ^ int(prints[b][i])).count("1") for i in range(similar.CHECKED)) <= similar.MOST:
                want.add((b, a))
    assert want and want <= {(a, b) for g in got.values() for a in g for b in g if a < b}
    linked = roots(range(len(sets)), lambda a, b: (a, b) in want)
    assert all(len({linked[k] for k in g}) == 1 for g in got.values())


def test_blocks_find_nearly_all_pairs_of_four_fifths_at_any_number_of_rows():
    rng = np.random.default_rng(8)
    for rows in (100, 10**5, 10**7):
        bits, few, many = similar.blocks(rows)
        lengths = similar.words_of(rows)
        assert rows <= 2**bits * similar.BUCKET
        for both, one, other in ((4, 0, 1), (12, 0, 3), (12, 1, 2), (80, 10, 10)):
            short, missed = both + other <= similar.SHORT, 0
            for _ in range(60):
                h = rng.integers(0, 2**63, both + one + other, dtype=np.uint64)
                v = np.stack([similar.signature(x, lengths[short]) for x in (h[: both + one], np.concatenate((h[:both], h[both + one :])))])
                keys = similar.block_keys(v, bits, many if short else few)
                missed += not (keys[0] == keys[1]).any() or np.bitwise_count(v[0, : similar.CHECKED] ^ v[1, : similar.CHECKED]).sum() > similar.MOST
            assert missed <= 1


def test_crowded_buckets_have_the_same_components():
    rng = np.random.default_rng(4)
    v = rng.integers(0, 2**63, (900, 3), dtype=np.uint64)
    for i in range(100, 700):  # chains: each near some earlier one
        v[i] = v[rng.integers(90, i)] ^ (np.uint64(1) << rng.integers(0, 63, 3, dtype=np.uint64))
    plain = similar.least_in_component(v, 4)
    assert len(set(plain.tolist())) < 600 and (similar._least_by_search(v, 4) == plain).all()


def test_representatives_keep_columns_and_odd_rows(docs, empty):
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 0 in ids and not set(range(100, 108)) & set(ids) and ids.count(5) == 1 and {303, 304, 305} <= set(ids)
    assert simhash.keep_representatives(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


# --- 7 quality -----------------------------------------------------------------------------------


def plain_measures(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(grams)
    marked = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_measures(docs):
    out, _ = quality.verdicts(docs)
    got = collected(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert collections.Counter(got) == collections.Counter((r[0], *plain_measures(r[1])) for r in rows())


def test_templates_are_counted_over_distinct_texts(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    data = [(i, f"Accept  All cookies now\n{body(i)}", "a") for i in range(10)]
    data += [(100 + i, f"only one text in many copies\n{body(99)}", "a") for i in range(30)]
    data += [(200 + i, f"accept all cookies NOW\n{body(i)}", "b") for i in range(2)]
    data += [(300 + i, "\n".join(["accept all cookies now"] * 13 + [f"own {i}"]), "a") for i in range(3)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    out, lines = quality.verdicts(df, min_docs=3, host_share=0.2)
    assert [r.host for r in lines.collect()] == ["a"]
    v = {r.doc_id: (r.removed_words, r.kept) for r in out.collect()}
    assert v[0] == (4, True) and v[100] == (0, True) and v[200] == (0, True) and v[300] == (52, False)
    clean = {r.doc_id: r for r in quality.clean(df, min_docs=3, host_share=0.2).collect()}
    assert 300 not in clean and clean[0].text == body(0) and clean[0].n_chars == len(body(0)) and clean[200].text.startswith("accept")


def test_quality_of_odd_tables(docs, empty):
    assert quality.clean(docs).columns == docs.columns and quality.clean(empty).count() == 0
    assert quality.verdicts(empty)[0].count() == 0


# --- 4 line dedup ------------------------------------------------------------------------------------


def test_winnowing_guarantee():
    rng = random.Random(2)
    for w in (2, 3, 5):
        shared = [rng.random() for _ in range(w)]
        for _ in range(50):
            a = [rng.random() for _ in range(rng.randint(0, 9))] + shared + [rng.random() for _ in range(rng.randint(0, 9))]
            b = [rng.random() for _ in range(rng.randint(0, 9))] + shared + [rng.random() for _ in range(rng.randint(0, 9))]
            pick = lambda x: {x[i] for i in line_dedup.minima(x, w)}
            assert pick(a) & pick(b) & set(shared)


def passage(tag, n):
    return " ".join(("Begin" if i == 0 else f"{tag}{i}") + ("." if i % 9 == 8 or i == n - 1 else "") for i in range(n))


def test_later_passages_go_and_first_ones_stay(spark):
    p = passage("shared", 60)
    other = lambda i: passage(f"own{i}x", 80)
    data = [(i, f"{other(i)} and {p} {passage(f'tail{i}x', 30)}") for i in (3, 1, 7)] + [(9, passage("lone", 70)), (10, passage("short", 12)), (11, f"{passage('q', 40)} {passage('short', 12)}")]
    out = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string"), report=True).collect()}
    text = dict(data)
    assert out[1].text == text[1] and out[9].text == text[9] and out[10].text == text[10] and out[11].text == text[11]
    for i in (3, 7):
        assert "shared5" not in out[i].text and out[i].text.startswith(other(i)) and out[i].text.rstrip().endswith(f"tail{i}x29.") and out[i].removed_runs == 1


def test_passages_without_sentences_go(spark):
    plain = " ".join(f"plain{i}" for i in range(60))  # no sentence end, no capital
    middle = " ".join(f"w{i}." if i % 20 == 19 else f"w{i}" for i in range(26))
    data = [(1, f"Of one {plain} and {middle} here."), (2, f"But two {plain} or so {middle} there."), (3, " ".join(middle.split()[:24]))]
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert out[1] == data[0][1] and out[2] == "But two or so there." and out[3] == data[2][1]


def test_a_passage_goes_whatever_occurrences_its_parts_have(spark):
    s = [" ".join(f"{tag}{i}" for i in range(15)).capitalize() + "." for tag in "abcd"]
    data = [(1, f"{s[0]} Alone."), (2, f"Own. {s[2]} Alone."), (5, f"Five. {' '.join(s)} End five."), (9, f"Nine. {' '.join(s)} End nine."), (10, "la " * 60)]
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert out[5] == data[2][1] and out[9] == "Nine. nine." and out[10] == "la " * 25


def deduped(data, min_words):
    """The words that stay of each id's text; ids occur once, but for repeated rows."""
    first, out = {}, {}
    for i, text in sorted(set(data), key=lambda r: (r[0] is None, r[0] or 0)):
        words, gone = text.split(), set()
        for s in range(len(words) - min_words + 1):
            at = first.setdefault(tuple(w.lower() for w in words[s : s + min_words]), (i, s))
            if at[0] != i or s >= at[1] + min_words:
                gone |= set(range(s, s + min_words))
        out[i] = [w for j, w in enumerate(words) if j not in gone]
    return out


@pytest.mark.parametrize(("gram_words", "min_words", "batch"), [(10, 25, 1024), (10, 25, 3), (3, 8, 2), (5, 5, 5)])
def test_line_dedup_against_brute_force(spark, monkeypatch, gram_words, min_words, batch):
    from veilgauge.llm import _common

    monkeypatch.setattr(_common, "BATCH_ROWS", batch)
    rng = random.Random(batch)
    vocabulary = [f"w{i}" for i in range(40)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    data = []
    for i in range(150):
        t = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                t += rng.choice(shared)
            elif kind < 0.6:
                t += [rng.choice(vocabulary)] * rng.randint(1, 70)
            elif kind < 0.7:
                t += vocabulary[:3] * rng.randint(1, 30)
            else:
                t += [rng.choice(vocabulary) + "x" * rng.choice([0, 0, 7, 90]) for _ in range(rng.randint(1, 40))]
        data.append((i or None, " ".join(t)))
    want = deduped(data, min_words)
    df = spark.createDataFrame(data + data[5:8], "doc_id long, text string").repartition(7)
    out = line_dedup.line_dedup(df, gram_words=gram_words, min_words=min_words).collect()
    assert len(out) == len(data) + 3 and all(r.text.split() == want[r.doc_id] for r in out)
    assert sum(map(len, want.values())) < sum(len(t.split()) for _, t in data) / 2


def test_line_dedup_of_odd_tables(docs, empty):
    out = line_dedup.line_dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and line_dedup.line_dedup(empty).count() == 0
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] == rows()[0][1] and all(got[100 + i] == "" for i in range(8)) and got[300] is None and got[301] == ""


# --- 1 mixing -------------------------------------------------------------------------------------------


def test_exponents():
    n = [1000, 100, 10]
    a = mixing.solve_exponent(n, max_repeats=4)
    assert abs(mixing.repeats(n, mixing.weights(n, a)) - 4) < 1e-9
    b = mixing.solve_exponent(n, target_entropy=0.9)
    assert abs(mixing.entropy(mixing.weights(n, b)) - 0.9) < 1e-9
    assert mixing.solve_exponent([5, 5], max_repeats=1) == 0.0 and mixing.solve_exponent(n, target_entropy=2.0) == 0.0
    with pytest.raises(ValueError):
        mixing.solve_exponent(n)


def test_mixture_meets_budgets_and_mix_agrees(docs):
    stream = mixing.mixture(docs, max_repeats=3.0, block_tokens=500).collect()
    uses = collections.Counter((r.doc_id, r.source) for r in stream)
    once = collections.Counter((r[0], r[3]) for r in rows())
    assert all(uses[k] >= n for k, n in once.items())
    tokens = collections.Counter()
    for r in rows():
        tokens[r[3]] += len((r[1] or "").split())
    mixed = collections.Counter()
    for r in stream:
        mixed[r.source] += r.tokens
    big = max(tokens.values())
    a = mixing.solve_exponent([n for n in tokens.values() if n], max_repeats=3.0)
    for s, n in tokens.items():
        if n:
            own = big * (n / big) ** a
            assert own - 1 <= mixed[s] <= own + max(r.tokens for r in stream if r.source == s) + 1
    blocks = collections.defaultdict(list)
    for r in stream:
        blocks[r.block].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in blocks.values())
    again = mixing.mixture(docs.repartition(7), max_repeats=3.0, block_tokens=500, digits=1)
    assert collections.Counter(collected(again)) == collections.Counter(tuple(r) for r in stream)
    plain = collections.Counter((r.doc_id, r.source) for r in mixing.mix(docs, max_repeats=3.0).collect())
    distinct = {k for k, n in once.items() if n == 1}
    assert all(plain[k] == uses[k] for k in distinct if k[0] is not None)


@pytest.mark.parametrize("how", [{"max_repeats": 3.0}, {"target_entropy": 1.2}])
def test_many_sources_are_mixed_as_few_are(docs, monkeypatch, how):
    few = mixing.mixture(docs, block_tokens=500, **how).collect()
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    many = mixing.mixture(docs, block_tokens=500, digits=3, **how).collect()
    assert sorted(map(repr, few)) == sorted(map(repr, many))
    assert collections.Counter(r.doc_id for r in mixing.mix(docs, **how).collect()) == collections.Counter(r.doc_id for r in mixing.mixture(docs, **how).collect())


def test_mixing_of_nothing(empty):
    assert mixing.mixture(empty).count() == 0 and mixing.mix(empty).count() == 0


# --- 6 packing ----------------------------------------------------------------------------------------------


def test_pieces_are_the_documents_and_windows_are_full(docs):
    enc = packing.encoder(packing.TOKENIZER)
    got = packing.pack(docs, window=256).collect()
    by, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    short = [w for w in windows.values() if sum(n for _, n in w) < 256]
    assert len(short) <= 1
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 256
    for r in rows():
        if r[0] is None or r[0] == 5:
            continue
        ids = np.array(enc.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by[r[0]], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(4)
    for counts in (rng.integers(0, 50, 65), np.bincount([40] * 1000, minlength=65), np.bincount([64, 64, 1], minlength=65), np.zeros(65, int)):
        counts[0] = 0
        plan = packing.Plan(counts, 64)
        length = np.repeat(np.arange(65), counts)
        number = np.concatenate([np.arange(c) for c in counts]) if counts.sum() else np.zeros(0, int)
        if not len(length):
            continue
        seq, offset, fits = plan.place(length, number)
        used = set()
        for s, o, n, f in zip(seq.tolist(), offset.tolist(), length.tolist(), fits.tolist(), strict=True):
            for cell in [(s, o + i) for i in range(f)] + [(s + 1, i) for i in range(n - f)]:
                assert cell not in used and cell[1] < 64
                used.add(cell)
        assert len(used) == length.sum() and plan.sequences == -(-length.sum() // 64)


def test_nnls_finds_what_fills():
    combos = packing.combinations_of(16)
    want = np.zeros(len(combos))
    want[[3, 12, 20]] = (50, 20, 10)
    counts = np.zeros(17)
    for j, n in enumerate(want):
        for x in combos[j]:
            counts[x] += n * (x > 0)
    x = packing.nnls(combos, counts)
    fit = np.zeros(17)
    for j, n in enumerate(x):
        for y in combos[j]:
            fit[y] += n * (y > 0)
    assert (x >= 0).all() and np.abs(fit - counts).max() < 1


def test_encoder_is_the_tokenizer():
    enc = packing.encoder(packing.TOKENIZER)
    texts = ["", "  lead", "Don't STOP it's we'll 'S 12 a.b@c.d", "a\xa0b c x\x1cy", "é Ǆ ß ﬁ ΑΣ ΣΑΣ. İ", "<|endoftext|> q<|startoftext|>r", "漢字かな交じり🙂🙂 !!..??"]
    for t, ids in zip(texts, enc.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


# --- 2 toxicity ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_model(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    bad = ["grobian", "knilch", "flegel", "halunke"]
    data = []
    for i in range(900):
        w = [rng.choice(vocabulary) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        data.append((" ".join(w), int(toxic)))
    df = spark.createDataFrame(data + [(None, 1), ("", 0), ("x", None)], "text string, toxic int")
    return toxicity.train(df, df), data


def test_disguised_words_are_restored(toxic_model):
    model, data = toxic_model
    shown = ["gr0b1an", "g r o b i a n", "k.n.i.l.c.h", "flllegeeel", "h@lunke!", "F-L-E-G-E-L", "KNILCH,", "grob​ian"]
    clean = ["", None, "a b c d", "r2d2 4711 c3po", data[1][0], "$$$ !!!"]
    got = model.scores(pa.array(shown + clean))
    assert (got[: len(shown)] >= 0.7).all() and (got[len(shown) :] < 0.7).all(), dict(zip(shown + clean, got.tolist(), strict=True))
    assert got[len(shown)] == got[len(shown) + 1]


def test_held_out_texts(toxic_model):
    model, data = toxic_model
    got = model.scores(pa.array([t for t, _ in data])) >= 0.7
    assert np.mean(got == np.array([y for _, y in data], bool)) > 0.97


def test_decoding_is_the_best_path():
    counts = np.bincount(toxicity._trigrams("the idiot met the idiot and the moron " * 50), minlength=64**3)
    m = toxicity.CharacterModel(counts)
    text = "1d1ot"
    options = collections.defaultdict(list)
    for at, end, letters, cost in toxicity.readings(text):
        options[at].append((end, letters, cost))

    def paths(at, out, tail, cost):
        if at == len(text):
            yield cost + m.step(tail, " ")[0], out
            return
        for end, letters, c in options[at]:
            total, t = cost + c, tail
            for ch in letters:
                more, t = m.step(t, ch)
                total += more
            yield from paths(end, out + letters, t, total)

    assert toxicity.decode(text, m) == min(paths(0, "", "", 0.0))[1] == "idiot"


def test_skipped_lattices_cannot_change_a_score():
    """Of a table of disguised words, glued with signs and split by spaces, the scores are those of decoding everything."""
    prose = "the idiot met an old idiot and the moron said that no moron may read on in that dirt road to the moor so idle men do dig it out " * 30
    characters = toxicity.CharacterModel(np.bincount(toxicity._trigrams(prose), minlength=64**3))
    lexicon = {"idiot$": 0.9, "idio": 0.9, "moron$": 0.8, "moor$": 0.4}
    quick, full = (toxicity.Model(lexicon, 0.1, characters, every=e) for e in (False, True))
    found = ["1d1ot", "foo%1d1ot", "foo&1d1ot", "you?1d1ot", "x)1d1ot", "<b>1d1ot</b>", "said\u20141d1ot", "well,1d1ot", "you/1d1ot", "total-1d1ot", "id iot", "mo r on", "ii d ii o t", "i. d. i. o. t.", "i d i o t s", "m0 r0n!", 'he said "id iot"', "i - d - i - o - t", "a1d1ot.idiiiioot", "m@@ m-o-r-o-n", "2id iot2"]
    other = ["id est", "i o u", "mo on", "the road", "r2d2 a b c", "more on that", "to do it", "- - - - i", "a a a a a a a", "i i i i i", "moo r", "!!! ... ???", "x" * 500, "i " * 60]
    got, want = quick.scores(pa.array(found + other)), full.scores(pa.array(found + other))
    assert np.allclose(got, want), [t for t, a, b in zip(found + other, got, want, strict=True) if abs(a - b) > 1e-9]
    assert (got[: len(found)] > 0.7).all(), [t for t, x in zip(found, got, strict=False) if x <= 0.7]
    assert (got[len(found) :] < 0.7).all(), [t for t, x in zip(other, got[len(found) :], strict=True) if x >= 0.7]
    rng = random.Random(4)
    letters = "idiotmrn  -.1!0%(s"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    got, want = quick.scores(pa.array(texts)), full.scores(pa.array(texts))
    assert np.allclose(got, want), [t for t, a, b in zip(texts, got, want, strict=True) if abs(a - b) > 1e-9][:5]
    assert (want > 0.1 + 1e-9).any()
    assert quick.restored(" He is an  1d1ot, a mo r on so\n") == " He is an  idiot a moron so\n" and quick.restored(None) is None
    assert quick.restored("") == "" and quick.restored("an OLD%1d1ot, id iot") == "an old%idiot idiot"


def test_purity_is_a_share_of_distinct_texts(spark):
    rng = random.Random(5)
    own = lambda: " ".join("".join(rng.choice("aeioustrn") for _ in range(6)) for _ in range(12))
    # few words before, many toxic texts, one mislabelled clean text; and a clean text of 40 copies
    data = [(f"{own()} before{i % 15} grobian {own()}", 1) for i in range(200)] + [(f"{own()} {own()} halunke", 1) for i in range(60)]
    data += [(own(), 0) for _ in range(600)] + [(f"{own()} grobian", 0)] + [(f"{own()} halunke", 0)]
    data += [data[-1]] * 40
    assert {"grobian$", "halunke$"} <= set(toxicity.train(df := spark.createDataFrame(data, "text string, toxic int"), df).lexicon)


def test_the_lexicon_holds_all_that_pass(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(7500)]
    data = []
    for _ in range(12):
        rng.shuffle(words)
        data += [(" ".join(words[i : i + 300]), 1) for i in range(0, 7500, 300)]
    df = spark.createDataFrame(data + [(f"clean text {i}", 0) for i in range(1200)], "text string, toxic int")
    assert len(toxicity.train(df, df).lexicon) > 20_000


def test_toxicity_of_odd_tables(docs, empty, toxic_model):
    out = toxicity.score(docs, toxic_model[0])
    assert out.count() == docs.count() and out.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> 0").count() == 0
    assert toxicity.score(empty, toxic_model[0]).count() == 0
    blank = toxicity.train(empty.selectExpr("text", "1 AS toxic"), empty)
    assert blank.lexicon == {} and 0 <= blank.scores(pa.array(["x"]))[0] <= 1


# --- 8 languages -----------------------------------------------------------------------------------------------------


def test_languages_are_told_apart(spark, empty):
    rng = random.Random(6)
    sounds = {"aa": ["ka", "lu", "mo", "ti"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["ção", "ñe", "ría", "que"]}
    make = lambda s, n: " ".join("".join(rng.choice(sounds[s]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    data = [(i, make(s, 50) + (" " + make("bb", 10) if i % 4 == 0 else ""), s) for i, s in enumerate(["aa", "bb", "cc"] * 40)]
    df = spark.createDataFrame(data + [(900, None, "aa"), (901, "kalu", None)], "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 3 <> 0 OR doc_id % 2 = 0"))
    asked = spark.createDataFrame([(1, make("aa", 5), "aa"), (2, make("cc", 5), "cc"), (3, None, "und"), (4, "123 !?", "und"), (5, "", "und"), (6, "KALU", "aa"), (7, make("bb", 2000), "bb")], "i long, text string, want string")
    for r in langid.predict(asked, model).collect():
        assert r.lang_pred == r.want and 0 <= r.score <= 1 and (r.score == 0) == (r.want == "und")
    assert langid.predict(empty, model).count() == 0
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(asked, nothing).collect()} == {"und"}


def test_more_languages_than_a_mask_holds(spark):
    rng = random.Random(6)
    words = {f"l{i:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for i in range(70)}
    data = [(lang, " ".join(rng.choice(ws) for _ in range(12))) for lang, ws in words.items() for _ in range(4)]
    df = spark.createDataFrame(data, "lang string, text string")
    model = langid.train(df)
    assert model.table.shape == (2, 1 << langid.SLOT_BITS) and len(model.languages) == 70
    assert langid.predict(df, model).where("lang_pred <> lang").count() == 0


def test_filter_holds_all_grams_and_few_others():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 32, 3000, dtype=np.uint32)
    table = np.zeros(1 << langid.SLOT_BITS, np.uint64)
    for s in langid.slots(codes):
        table[s] |= np.uint64(4)
    fill = float((table > 0).mean())
    m = langid.Model(["a", "b", "c"], table[None], np.array([0.0, 0.0, fill**3]))
    assert m.counts(codes)[2] == len(codes) and m.counts(rng.integers(0, 1 << 32, 20000, dtype=np.uint32))[2] < 20


def test_folds(spark):
    got = dict(collected(spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "i long").select("i", langid.held_out(F.col("i"), 4, 2))))
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(50)) and got[None] is False


# --- 9 WARC ---------------------------------------------------------------------------------------------------------------


def test_archives_come_back(spark):
    page = "<p>" + "é🙂" * 60 + "</p>"
    data = [(5, "http://a/x y", page), (2, "http://b", page), (None, "http://c", page), (9, None, page), (7, "u", "short"), (8, "u", "short"), (1, "http://n", None), (2, "http://b", page), (11, "http://e", "WARC/1.1\r\n\r\nx" * 20), (12, "big", "z" * 300_000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    index = warc.archive_pages(df)
    assert index.count() == len(data)
    got = warc.read_records(index).collect()
    want = []
    for i, u, h in data:
        raw = (h or "").encode()
        again = len(raw) >= 100 and h == page and i != 2
        want.append((i, u, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 2 if again else None, None if again else raw))
    assert collections.Counter(map(str, want)) == collections.Counter(str((*tuple(r)[:6], None if r.payload is None else bytes(r.payload))) for r in got)
    some = warc.read_records(index.where("page_id IN (5, 12)"), most=1000, gap=10).collect()
    assert sorted(r.page_id for r in some) == [5, 12]


def test_damage_is_noticed():
    raw = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), "response", None)
    assert warc.parse(raw)[2] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw[:-5])


def test_ranges_are_joined():
    assert warc.coalesced([(0, 10), (10, 10), (25, 5), (100, 10)], most=40, gap=8) == [(0, 30, [0, 1, 2]), (100, 110, [3])]
    assert warc.coalesced([(0, 10), (10, 50)], most=40, gap=8) == [(0, 10, [0]), (10, 60, [1])] and warc.coalesced([]) == []


def test_no_pages(spark):
    index = warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))
    assert index.count() == 0 and warc.read_records(index).count() == 0


# --- 10 neighbours -----------------------------------------------------------------------------------------------------------


def nearest_by_force(vectors, every, k):
    out = set()
    ids = sorted(vectors)
    for q in ids:
        if q % every == 0:
            a = np.array(vectors[q], float)
            near = sorted((-round(float(a @ np.array(vectors[i], float) / math.sqrt(float(a @ a) * float(np.dot(vectors[i], vectors[i])))), 12), i) for i in ids if i != q)
            out |= {(q, r, i) for r, (_, i) in enumerate(near[:k], 1)}
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    vectors = {i: (centres[i % 12] + 0.3 * rng.standard_normal(16)).astype(np.float32).tolist() for i in range(1500)}
    for i in range(300, 420):  # a crowd of one vector
        vectors[i] = vectors[300]
    data = list(vectors.items()) + [(5000, None), (5010, [0.0] * 16), (5020, [float("nan")] * 16), (5030, [1.0, None] + [0.0] * 14), (5040, [1.0] * 3), (None, [1.0] * 16), (10, vectors[10])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, every=10, sample_rows=800, leaf_rows=32, block_queries=40).collect()}
    want = nearest_by_force(vectors, 10, 5)
    assert len(got) == len(want)
    pairs = lambda x: {(q, i) for q, _, i in x}
    assert len(pairs(got) & pairs(want)) >= 0.95 * len(want)
    assert {x for x in got if x[0] == 310} == {x for x in want if x[0] == 310}


def test_a_leaf_is_multiplied_with_its_own_queries_only():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 24))
    x = np.concatenate([c + 0.25 * rng.standard_normal((50, 24)) for c in centres])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    forest = [ann.grow(unit, 32, np.random.default_rng([1, t])) for t in range(8)]
    start = np.concatenate([[0], np.cumsum([t.leaves for t in forest])])
    leaves = np.stack([start[t] + tree.leaf_of(unit) for t, tree in enumerate(forest)], axis=1)
    enough = ann.probe_share(forest, unit, 5, 0.98) * len(x)
    sizes = np.bincount(leaves.ravel(), minlength=start[-1])
    taken, asked = [], np.arange(0, len(x), 50)
    for q in asked:
        own, got = [], 0
        for t, leaf in ann.walk(forest, unit[q]):
            own.append(int(start[t]) + leaf)
            got += sizes[own[-1]]
            if got >= enough:
                break
        taken.append(np.array(own))
    search = ann.Search(x[asked], *ann.by_leaf(taken, int(start[-1])), keep=12)
    for at in range(0, len(x), 700):
        search.add(np.arange(len(x))[at : at + 700], x[at : at + 700], leaves[at : at + 700])
    assert search.products == sum(int(sizes[t].sum()) for t in taken) <= 0.2 * len(x) * len(asked)
    full = unit[asked] @ unit.T
    query, cid, _ = search.best
    hits = sum(len(set(np.argsort(-full[i])[:6].tolist()) & set(cid[query == i].tolist())) for i in range(len(asked)))
    assert hits >= 0.95 * 6 * len(asked)


def test_registered_neighbours_reach_the_recall(spark, tmp_path):
    rng = np.random.default_rng(9)
    vectors = {i: rng.standard_normal(24).astype(np.float32).tolist() for i in range(3000)}
    vectors[100] = [2 * x for x in vectors[50]]
    vectors[101] = [8 * x for x in vectors[50]]
    spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op10_nearest_neighbours(spark, str(tmp_path)).collect()
    want = nearest_by_force(vectors, 50, 5)
    assert len(got) == len(want) and len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i in want}) >= 0.9 * len(want)
    for r in got:
        a, b = (np.array(vectors[i], float) for i in (r.query_id, r.vec_id))
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], kind)).count() == 0
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], kind)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 2), (0, 2, 1)]


def test_long_fingerprints_of_odd_texts():
    assert not similar.fingerprint(None).any() and not similar.fingerprint(b" ").any() and similar.fingerprint(b"one").any()
    v = np.array([[0, 0], [1, 0], [3, 0], [2**63, 7]], dtype=np.uint64)
    assert similar.least_in_component(v, 1).tolist() == [0, 0, 0, 3]

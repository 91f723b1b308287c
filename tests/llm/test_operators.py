"""The ten operators against plain versions, and on odd, clashing and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows, prose
from veritile.llm import (
    chat_format,
    components,
    decontamination,
    html_text,
    language_id,
    lattice,
    line_dedup,
    packing,
    quality_rules,
    simhash,
    token_counts,
)

WS = " \t\n\x0b\x0c\r"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


# 1 ---------------------------------------------------------------------------------------------------------------------


def ways(word, number, score):
    """The summed probability of all segmentations, one letter after the other."""
    marked = lattice.START + word
    a = [0.0] + [-math.inf] * len(marked)
    for end in range(1, len(marked) + 1):
        x = [a[start] + score[number[marked[start:end]]] for start in range(max(0, end - 20), end) if marked[start:end] in number]
        if marked[end - 1] not in number:
            x.append(a[end - 1] + score[-2])
        a[end] = np.logaddexp.reduce(x)
    return a[-1] + score[-1]


def test_lattice_sums_all_segmentations(monkeypatch):
    path = lattice.vocabulary_path()
    voc = lattice.vocabulary(path)
    number = {p: k for k, p in enumerate(voc.pieces)}
    rng = np.random.default_rng(3)
    score = np.concatenate([np.log(rng.dirichlet(np.ones(len(voc.pieces)))), [-30.0, -1.0]])
    words_ = ["hello", "straße", "aaa", "x日y", "", "ing", "internationalization" * 40, "q😀" * 300, "z" * 800]
    for block in (65_536, 50):
        monkeypatch.setattr(lattice, "LONG_BLOCK", block)
        assert lattice.likelihoods(words_, score, path) == pytest.approx([ways(w, number, score) for w in words_])


def test_expected_uses(monkeypatch):
    path = lattice.vocabulary_path()
    score = lattice.vocabulary_scores(path)
    uses = lattice.expected_uses(["abc", "z"], score, path)
    assert (uses[:-1] * lattice.vocabulary(path).lengths).sum() == pytest.approx(len("▁abc") + len("▁z"))
    assert uses[-1] == 2
    # A long word in blocks has the uses that one lattice gives, and uses are the slope of the likelihood.
    word = "internationalization" * 30
    monkeypatch.setattr(lattice, "LONG_BLOCK", 70)
    whole = lattice.Lattice([word], path)
    assert lattice.expected_uses([word], score, path) == pytest.approx(whole.expected(score))
    k = int(np.argmax(uses[:-2]))
    up, down = score.copy(), score.copy()
    up[k] += 1e-4
    down[k] -= 1e-4
    both = lattice.likelihoods(["abc", "z"], up, path) - lattice.likelihoods(["abc", "z"], down, path)
    assert both.sum() / 2e-4 == pytest.approx(uses[k], abs=1e-4)


def test_score_documents(spark, odd, clashing, none):
    got = lattice.score_documents(odd, frequent=30).collect()
    rows = odd_rows()
    assert len(got) == len(rows)
    counts, ends = Counter(), 0
    for i, t, *_ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(words(lower(t or "")))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((i is None, i or 0, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, round(sum(base(counts[x]) for x in w) + base(ends), 6)) for i, t, *_ in rows for w in [words(lower(t or ""))])
    assert want == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    pairs = lambda docs, **k: sorted((str(r[0]), r[1], round(r[2], 4)) for r in lattice.score_documents(docs, **k).select("doc_id", "n_tokens", "score").collect())
    assert pairs(clashing) == pairs(odd, frequent=5)
    # The score against plain sums over words: whole-word arcs by discounted counts, and the lattice of all segmentations.
    path = lattice.vocabulary_path()
    counted = spark.createDataFrame([(w.encode(), c, c) for w, c in counts.items()], "word binary, c long, n long")
    fitted = lattice.fit(counted, path=path)
    number = {p: k for k, p in enumerate(lattice.vocabulary(path).pieces)}
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))

    def log10(w):
        whole = math.log((counts[w] - discount) / n) if counts[w] > discount else -math.inf
        return np.logaddexp(whole, ways(w, number, fitted) + math.log(discount * v / n)) / math.log(10)

    each = {w: log10(w) for _, t, *_ in rows for w in words(lower(t or ""))}
    plain = sorted(sum(each[w] for w in words(lower(t or ""))) + math.log10((ends - discount) / n) for _, t, *_ in rows)
    assert plain == pytest.approx(sorted(r["score"] for r in got), rel=1e-6, abs=1e-3)
    assert lattice.score_documents(none).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------------


def plain_quality(t):
    t = t or ""
    w = words(t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_counts(odd, clashing, none):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for docs in (odd, clashing):
        got = quality_rules.evaluate(docs).select(*cols).collect()
        assert sorted(map(tuple, got)) == sorted(plain_quality(t) for _, t, *_ in odd_rows())
    assert quality_rules.evaluate(none).count() == 0


def test_quality_verdicts(spark):
    good = "\n".join(prose(9, 70 + k) for k in range(12))
    menu = "\n".join(f"Home{k} | About{k} | Contact{k} | Help{k} | More{k} | Last{k} | End{k}" for k in range(12))
    loud = "\n".join(f"THIS IS LOUD{k}!! VERY LOUD!! AND MORE!! OF IT!! HERE{k}!!" for k in range(12))
    rows = [(1, good), (2, menu), (3, loud), (4, good + "\nAll rights reserved by the owner of this.\n" + menu[:120])]
    got = dict(quality_rules.evaluate(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "kept").collect())
    assert got == {1: True, 2: False, 3: False, 4: True}


# 3 ---------------------------------------------------------------------------------------------------------------------


def plain_distance(a, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_is_edit_distance():
    r = random.Random(2)
    for _ in range(200):
        a, t = ("".join(r.choice("abc") for _ in range(r.randint(1, 70))) for _ in (0, 1))
        best, end = decontamination.myers(a, t)
        assert best == plain_distance(a, t) and (best == len(a) or plain_distance(a, t[:end]) == best)


def test_pigeonhole_finds_all(spark, none, clashing):
    r = random.Random(4)
    items = [(k, prose(r.randint(12, 40), 900 + k)) for k in range(6)]
    texts = []
    for k in range(60):
        i, t = items[k % 6]
        chars = list(decontamination.normalized(t))
        for _ in range(r.randint(0, int(len(chars) * 0.14))):
            at = r.randrange(len(chars))
            r.choice((lambda: chars.insert(at, "q"), lambda: chars.pop(at), lambda: chars.__setitem__(at, "w")))()
        texts.append((k, prose(30, 2000 + k) + "  \n" + "".join(chars).upper() + " " + prose(30, 3000 + k)))
    texts += [(98, None), (99, "")]
    want = {(i, j) for i, t in texts for j, x in items if plain_distance(decontamination.normalized(x), decontamination.normalized(t)) <= decontamination.budget(decontamination.normalized(x))}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    item_rows = spark.createDataFrame([*items, (70, None), (71, "  "), (None, "x" * 90), items[0]], "item_id long, text string")
    for letters in (10_000, 100):
        got = decontamination.annotate(docs, item_rows, letters=letters).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item").collect()
        assert {tuple(x) for x in got} == want and 10 < len(want) < 60
    assert decontamination.clean_stage(docs, item_rows).count() == len(texts) - len({i for i, _ in want})
    assert decontamination.annotate(none, item_rows).count() == 0
    assert decontamination.annotate(clashing, item_rows.limit(0)).count() == len(odd_rows())


# 4 ---------------------------------------------------------------------------------------------------------------------


def test_lines(odd, clashing, none):
    rows = odd_rows()
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            holders[lower(x.strip(WS))].add((i, t))
    want = sorted(
        ("\n".join(x for x in (t or "").split("\n") if not (k := lower(x.strip(WS))) or len(holders[k]) < 10), len((t or "").split("\n"))) for _, t, *_ in rows
    )
    for docs in (odd, clashing):
        got = line_dedup.drop_lines(docs).select("kept_text", "n_lines", "n_dropped").collect()
        assert sorted((r[0], r[1]) for r in got) == want
        assert sum(r[2] for r in got) == 24
    kept = line_dedup.drop_lines(odd, keep_first=True).where("n_dropped = 0 and doc_id >= 100").select("doc_id").collect()
    assert [r[0] for r in kept] == [100]
    assert line_dedup.drop_lines(none).count() == 0
    staged = line_dedup.dedup_stage(odd)
    assert staged.columns == odd.columns and staged.count() == len(rows)
    low = line_dedup.drop_lines(odd, min_docs=2, keep_first=True)
    assert low.where("doc_id = 8").select(F.length("kept_text")).first()[0] == 0


def test_bitmap_is_sparse(spark):
    docs = spark.createDataFrame([(k, "\n".join(f"{k}-{j}" if j != 150 else "same" for j in range(200))) for k in range(12)], "doc_id long, text string")
    got = line_dedup.drop_bitmaps(docs).collect()
    assert len(got) == 12 and all([tuple(x) for x in r["bitmap"]] == [(2, 1 << 22)] for r in got)


# 5 ---------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.vocabulary_path())


def test_transducer_equals_library(library):
    m = token_counts.machine(token_counts.vocabulary_path())
    r = random.Random(1)
    letters = "abcdeést'’ 1²!?#$éàñßΣİ\n\t日本<|>endoftext"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["'rex 're I'VE ''s", "ΣΑΣ ΟΔΥΣΣΕΥΣ.", "x<|endoftext|>'s<|startoftext|>", "\x1c a\x1fb", "", "'", "9" * 9, *(t for _, t, *_ in odd_rows() if t)]
    for t in texts:
        assert token_counts.count_tokens(m, t) == len(library.encode(t, add_special_tokens=False).ids), t[:80]


def test_chunks_compose():
    m = token_counts.machine(token_counts.vocabulary_path())
    t = token_counts.normalized(prose(60, 3) + "x" * 40 + " it's 're " + "!" * 30 + "\x1c \x1fy")
    whole = token_counts.count_tokens(m, t)
    for size in (1, 2, 7, 64):
        assert token_counts.count_tokens(m, t, size) == whole
    # Composition has tables of states only, and is associative.
    maps = token_counts.chunk_maps(m, t, 9)
    left, right = maps[0], maps[-1]
    for x in maps[1:]:
        left = token_counts.compose(left, x)
    for x in maps[-2::-1]:
        right = token_counts.compose(x, right)
    assert left == right == token_counts.prefix_scan(maps)[-1]
    assert all(isinstance(n, int) and kind in ("start", "letters", "marks", "'", "'r", "'v", "'l") for x in maps for (kind, _), n in x.values())


def test_text_without_white_space(library):
    m = token_counts.machine(token_counts.vocabulary_path())
    t = "".join(random.Random(3).choice("abcdefgh") for _ in range(60_000))
    assert token_counts.count_tokens(m, t) == len(library.encode(t, add_special_tokens=False).ids)


def test_counts_are_the_same_after_clearing(odd, clashing, none, monkeypatch):
    want = sorted(r[0] for r in token_counts.counts(odd).select("n_tokens").collect())
    assert sorted(r[0] for r in token_counts.counts(clashing).select("n_tokens").collect()) == want
    assert token_counts.counts(none).count() == 0
    m = token_counts.machine(token_counts.vocabulary_path())
    monkeypatch.setattr(token_counts, "MOST_STATES", 3)
    assert sorted(token_counts.count_tokens(m, t) for _, t, *_ in odd_rows()) == want


# 6 ---------------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def plain_maximal(rows):
    by = defaultdict(set)
    for r in rows:
        by[r[0]].add(r[1:])
    null_first = lambda x: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in x)
    convs = {c: tuple((x[1], x[2]) for x in sorted(ts, key=null_first)) for c, ts in by.items()}
    keep = set()
    for c, t in convs.items():
        if not any(len(u) > len(t) and u[: len(t)] == t for u in convs.values()) and not any(u == t and (d is not None and (c is None or d < c)) for d, u in convs.items()):
            keep.add(c)
    return {c: len(convs[c]) for c in keep}


def test_snapshots(spark):
    r = random.Random(5)
    rows = []
    for c in range(80):
        base = r.randint(0, 9)
        for k in range(r.randint(1, 9)):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", f"{base if k < 6 else c} turn {k}"))
    rows += rows[:5] + [(None, 0, None, None), (None, 1, "user", ""), (900, None, "user", "x")]
    got = chat_format.render(spark.createDataFrame(rows, TURNS).withColumn("idx", F.lit(1)), part_turns=3).collect()
    sizes = {r["conv_id"]: r["n_turns"] for r in got}
    assert sizes == plain_maximal(rows)
    assert all(len([x for x in got if x["conv_id"] == c]) == -(-n // 3) for c, n in sizes.items())
    first = next(r for r in got if r["conv_id"] == 900)
    assert first["text"] == "<|im_start|>user\nx<|im_end|>\n"
    assert chat_format.render(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversation_spans_partitions(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(3000)] + [(2, k, "user", f"t{k}") for k in range(2500)] + [(3, k, "user", f"t{k}") for k in range(2499)] + [(3, 2499, "user", "other")]
    df = spark.createDataFrame(rows, TURNS)
    assert {r["conv_id"]: r["n_turns"] for r in chat_format.render(df).collect()} == {1: 3000, 3: 2500}


# 7 ---------------------------------------------------------------------------------------------------------------------


def plain_components(ids, near):
    best = dict(zip(range(len(ids)), ids))
    changed = True
    while changed:
        changed = False
        for a, row in enumerate(near):
            least = min(best[b] for b in np.nonzero(row)[0])
            if least < best[a]:
                best[a], changed = least, True
    return best


def test_simhash_definition():
    import xxhash

    t = "A b c D e f A b c"
    grams = [" ".join(t.lower().split()[k : k + 3]) for k in range(7)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.simhash(t) == want and simhash.simhash(None) == 0 == simhash.simhash(" \n")
    assert simhash.simhash("One Two") == xxhash.xxh64_intdigest(b"one two", 42)


@pytest.mark.parametrize("radius,hot", [(2, 4096), (2, 2), (8, 16)])
def test_links_are_exact(spark, radius, hot):
    r = random.Random(6)
    fps = [r.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        x = r.choice(fps)
        for _ in range(r.randint(1, radius + 2)):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    fps = np.array(sorted(set(fps)), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
    df = spark.createDataFrame([(int(x), int(x)) for x in fps.view(np.int64)], "fp long, node long")
    labels = {r["node"]: r["rep"] for r in components.connected(simhash.links(df, radius, hot=hot)).collect()}
    want = plain_components(list(range(len(fps))), near)
    got = defaultdict(set)
    for k, x in enumerate(fps.view(np.int64).tolist()):
        got[labels.get(x, x)].add(k)
    groups = defaultdict(set)
    for k, g in want.items():
        groups[g].add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_classes(odd, clashing, none):
    rows = odd_rows()
    fps = np.array([simhash.simhash(t) for _, t, *_ in rows], np.uint64)
    ids = [10**9 if i is None else i for i, *_ in rows]
    want = plain_components(ids, np.bitwise_count(fps[:, None] ^ fps[None]) <= 2)
    for docs in (odd, clashing):
        got = simhash.classes(docs).collect()
        assert sorted((10**9 if r[0] is None else r[0], 10**9 if r[2] is None else r[2]) for r in got) == sorted(zip(ids, want.values()))
    assert simhash.classes(none).count() == 0
    staged = simhash.near_dedup_stage(odd)
    kept = [r["doc_id"] for r in staged.collect()]
    assert staged.columns == odd.columns and kept.count(7) == 1 and 8 not in kept and 9 not in kept and kept.count(None) == 1


def test_components_of_a_path(spark):
    ids = list(range(300))
    df = spark.createDataFrame([(a, a + 1) for a in ids[:-1]] + [(1000, 1001), (5, 5)], "u long, v long")
    got = {r["node"]: r["rep"] for r in components.connected(df).collect()}
    assert len({got[i] for i in ids}) == 1 and got[1000] == got[1001] != got[0] and len(got) == 302


# 8 ---------------------------------------------------------------------------------------------------------------------


def test_packing(spark, odd, clashing, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    for docs in (odd, clashing):
        got = packing.pack_documents(docs, with_ids=True).collect()
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append(r)
        for rows in by.values():
            rows.sort(key=lambda r: r["offset"])
            assert [r["offset"] for r in rows] == list(np.cumsum([0] + [r["length"] for r in rows[:-1]])) and sum(r["length"] for r in rows) <= 2048
        assert len(by) <= -(-sum(r["length"] for r in got) // 2048) + 1
        want = []
        for i, t, *_ in odd_rows():
            ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
            first = len(ids) % 2048 or 2048
            cuts = [0, *range(first, len(ids) + 1, 2048)]
            want += [(-1 if i is None else i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert packing.pack_documents(none).count() == 0
    parts = packing.pack_documents(odd, with_ids=True)
    assert packing.sequences(parts).agg(F.sum(F.octet_length("ids"))).first()[0] == 4 * sum(r["length"] for r in got)


def test_best_two_fit():
    # Greedy leaves 10 - 6 - 3 = 1; 2 + 2 fill the room of the 3.
    done = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert done[0] == (1, Counter({6: 1, 2: 2}))
    r = random.Random(7)
    for _ in range(50):
        counts = Counter(r.randint(1, 60) for _ in range(r.randint(0, 200)))
        done = packing.plan(counts, 64)
        used = Counter()
        for bins, content in done:
            assert sum(n * k for n, k in content.items()) <= 64
            for n, k in content.items():
                used[n] += bins * k
        assert used == counts


def plain_bins(lengths, room):
    """One bin after the other: the longest that fits, again and again; then the shortest makes room for the best two."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        held, free = [], room
        while (fits := next((x for x in left if x <= free), None)) is not None:
            left.remove(fits)
            held.append(fits)
            free -= fits
        while free and len(held) > 1:
            least = min(held)
            pairs = [(a + b, a, b) for k, a in enumerate(left) for b in left[k + 1 :] if least < a + b <= free + least]
            if not pairs:
                break
            total, a, b = max(pairs)
            held.remove(least)
            held += [a, b]
            left.remove(a)
            left.remove(b)
            left = sorted([*left, least], reverse=True)
            free += least - total
        bins.append(sorted(held))
    return sorted(bins)


def test_plan_is_that_of_one_bin_after_the_other():
    r = random.Random(17)
    for _ in range(150):
        lengths = [r.randint(1, 40) for _ in range(r.randint(0, 60))]
        done = packing.plan(Counter(lengths), 48)
        got = sorted(sorted(Counter(content).elements()) for bins, content in done for _ in range(bins))
        assert got == plain_bins(lengths, 48)


# 9 ---------------------------------------------------------------------------------------------------------------------


def test_gradients():
    net = language_id.train(["hello abc", "der die das", "le la"], ["a", "b", "c"], steps=1, hidden=3)
    w = language_id.Windows([b"hello", b"der die das hhh", b"le"], 16)
    x, n = w.pick(slice(None)), w.n
    y = np.array([0, 1, 2])

    def loss():
        p = language_id._scores(net, x, n).astype(float)
        return -sum(np.log(p[: n[j], y[j], j]).sum() for j in range(3)) / n.sum()

    for p, g in zip(net.parameters(), language_id._gradients(net, x, n, y)):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[k]
        p[k] = old + 0.01
        up = loss()
        p[k] = old - 0.01
        down = loss()
        p[k] = old
        assert (up - down) / 0.02 == pytest.approx(g[k], abs=2e-3)


def test_positions_pool_to_the_document():
    net = language_id.train(["hello abc the", "der die das und"], ["en", "de"], steps=5, hidden=4)
    for t in ("x", "Der " * 100, "é" * 77):
        p = language_id.label_positions(net, t)
        assert p.shape == (len(t.lower().encode()), 2)
        assert language_id.document_scores(net, ["pad", t])[1] == pytest.approx(p.mean(axis=0), abs=1e-5)


def test_language(spark, odd, clashing, none):
    en, de = "the house of the man is on the hill and it was old", "das haus von dem mann ist auf der anhöhe und es war alt"
    rows = [(k, " ".join(random.Random(k).sample((en if k % 2 else de).split(), 9)), "en" if k % 2 else "de") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(df, steps=60)
    got = language_id.predict(df, net).where(language_id.held_out()).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.9 * len(got) > 20
    for docs in (odd, clashing):
        out = language_id.predict(docs, net).collect()
        assert len(out) == len(odd_rows()) and all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) and 0 <= r["score"] <= 1 for r in out)
    empty = language_id.fit(none)
    assert empty.labels == [] and language_id.predict(odd, empty).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(none, net).count() == 0
    assert language_id.language_stage(odd).columns == odd.columns
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.language_stage(unlabelled).count() == len(odd_rows())  # nothing is learned, nothing rejected


def test_sample_is_whole_and_bounded(spark):
    rows = [(k, f"{k} " + "word " * 500, f"label{k}") for k in range(400)] + [(k, f"{k} text", "en") for k in range(1000, 3000)]
    texts, langs = language_id.sample(spark.createDataFrame(rows * 2, "doc_id long, text string, lang string"), "doc_id", "text", "lang", rows=500)
    assert 350 < len(texts) <= 500 and len(set(langs)) > 300 and len(set(texts)) == len(texts)
    assert all(t in {r[1] for r in rows} for t in texts)


def plain_network(net, data):
    """Gated recurrence as written on paper, byte by byte, both ways; the label distribution of each byte of one window."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    hidden = net.u[0].shape[1]

    def states(d, seen):
        h, out = np.zeros(hidden), []
        for byte in seen:
            given, own = net.e[d][:, byte].astype(float), net.u[d].astype(float) @ h
            r = sigmoid(given[:hidden] + own[:hidden])
            z = sigmoid(given[hidden : 2 * hidden] + own[hidden : 2 * hidden])
            c = np.tanh(given[2 * hidden :] + r * own[2 * hidden :])
            h = z * h + (1 - z) * c
            out.append(h)
        return out

    ahead, behind = states(0, data), states(1, data[::-1])[::-1]
    x = np.array([net.w[0] @ a + net.w[1] @ b + net.b for a, b in zip(ahead, behind)])
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_forward_pass_is_that_of_the_formulas():
    net = language_id.train(["hello abc the", "der die das und"], ["en", "de"], steps=5, hidden=4)
    for t in ("x", "Hello der", "é" * 100, "the " * 90):
        data = t.lower().encode()
        want = np.concatenate([plain_network(net, data[k : k + language_id.WINDOW]) for k in range(0, len(data), language_id.WINDOW)])
        assert language_id.label_positions(net, t) == pytest.approx(want, abs=1e-5)


# 10 --------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies to make the site work for all of you and more.</div><nav><a href=x>Home</a></nav>
<article><header><h2>The title</h2></header><p>It goes on &amp; on &#8212; and has a <a href="y">link</a> in it that is of no use to the reader
who has read all of this before and will read it again when they can.</p><p>Short one.<p>
<div class="ad">Buy the thing that is the best of all the things</div><table><tr><td>a</td><td>b</td></tr></table></article>
<div id="comments"><p>I liked it, and the way it is written is the best of all that I have read in all my years of reading it.</p></div>
<aside>Related: other</aside><form><label>Mail</label><p>Sign up to the list</p></form><footer>&copy; us</footer><!-- open <p>no"""


def test_pages(spark):
    want = "The title\nIt goes on & on — and has a link in it that is of no use to the reader who has read all of this before and will read it again when they can.\nShort one.\na b"
    assert html_text.main_text(PAGE) == want
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<"), (4, "u", "<p title='x>y" * 300), (5, "u", "a < b & c &lt; d")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("_x", F.lit(2))).collect()
    assert len(got) == 6 and {r["n_chars"] for r in got if r["page_id"] in (2, 3)} == {0}
    assert next(r for r in got if r["page_id"] == 1)["text"] == want


def test_pages_of_any_length(spark):
    """Time grows with the length, whatever is left open; ties and repeated rows; no rows."""
    import time

    pages = ["<div>x " * 300_000, "<b>" * 100_000 + "</i>" * 200_000, "<a " * 500_000, '<a ">"' * 300_000, "<p>short one</p>" * 100_000, "<script>" + "</script " * 200_000, "<!--" * 500_000, "<!x" * 500_000]
    began = time.time()
    for p in pages:
        html_text.main_text(p)
    assert time.time() - began < 60
    assert html_text.main_text("<p>&#" + "9" * 6000 + ";" + "0" * 9 + "</p>") == "" and html_text._unescaped("&#" + "0" * 5000 + "65;&#x000000000041;") == "AA"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, "u", PAGE)]
    schema = "page_id long, url string, html string"
    got = [r["text"] for r in html_text.extract(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == 3 and len(set(got)) == 1
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def plain_second_pass(found):
    """The nearest decided blocks by looking at all of them."""
    firsts = [html_text.first_pass(b) for b in found]
    decided = [k for k, (label, _) in enumerate(firsts) if label != "open"]
    keep = []
    for k, b in enumerate(found):
        label, leans = firsts[k]
        if label == "open" and b.article:
            own = [j for j in decided if not found[j].bad and all(found[x].container == b.container for x in range(min(j, k), max(j, k) + 1))]
            best = min(((abs(j - k), firsts[j][0]) for j in own), default=(0, "good"))
            label = best[1]
        elif label == "open":
            left = max((j for j in decided if j < k), default=-1)
            right = min((j for j in decided if j > k), default=len(found))
            a, c = (firsts[j][0] if 0 <= j < len(found) else "bad" for j in (left, right))
            tie = "good" if leans else "bad"
            label = a if a == c or k - left < right - k and not (b.heading and c == "good") else c if right - k < k - left or b.heading and c == "good" and right - k != k - left else tie
        keep.append(label == "good")
    return keep


def test_undecided_blocks_take_the_nearest_label():
    r = random.Random(8)
    long = "This is the text of the page and it is as long as it has to be for the rules to take it as the one that is of use. " * 3
    for _ in range(300):
        found = [
            html_text.Block(r.choice((long, "a bit", "of the and it", "Lots Of Names Here " * 9)), r.choice((0, 0, 50)), c, r.random() < 0.1, c > 0, r.random() < 0.2)
            for c in (r.choice((0, 0, 1, 2)) for _ in range(r.randint(0, 12)))
        ]
        assert html_text.second_pass(found) == plain_second_pass(found)


def test_blocks_without_containers():
    long = "This is the text of the page and it is as long as it has to be for the rules to take it as the one that is of use to those who read it. " * 3
    page = f"<div><a href=1>One</a> <a href=2>Two</a></div><p>{long}</p><p>A bit more.</p><p>{long}</p><div><a href=3>Next</a></div><p>x y z</p>"
    assert html_text.main_text(page) == "\n".join((long.strip(), "A bit more.", long.strip()))


# all -------------------------------------------------------------------------------------------------------------------


def own_names():
    """Every quoted name in the operators' sources that could be a column of theirs."""
    from pathlib import Path

    found = set()
    for path in Path(lattice.__file__).parent.glob("*.py"):
        found |= set(re.findall(r"\"(_?[a-z][a-z0-9_]*)\"", path.read_text()))
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars", "page_id", "html"})


def test_columns_of_the_caller_stay(spark):
    base = [(k, f"A line of text that is number {k}.\nShared line here.", "en") for k in range(12)]
    df = spark.createDataFrame(base, "doc_id long, text string, lang string")
    names = own_names()
    assert {"_text", "whole", "k1", "hits", "n_tokens", "score", "kept", "row", "node"} & set(names) and len(names) > 100
    full = df.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names))
    net = language_id.train(["abc"], ["en"], steps=1, hidden=2)
    items = spark.createDataFrame([(1, "an item that is in no text at all, however long")], "item_id long, text string")
    runs = {
        "op2": (quality_rules.evaluate(full), {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"}),
        "op3": (decontamination.annotate(full, items), {"hits"}),
        "op4": (line_dedup.drop_lines(full), {"n_lines", "n_dropped", "kept_text"}),
        "op5": (token_counts.counts(full), {"n_tokens"}),
        "op9": (language_id.predict(full, net), {"lang_pred", "score"}),
        "op10": (html_text.extract(full.withColumnRenamed("text", "html")), {"text", "n_chars"}),
        "stage 1": (language_id.language_stage(full), set()),
        "stage 2": (line_dedup.dedup_stage(full), {"text"}),
        "stage 3": (simhash.near_dedup_stage(full), set()),
        "stage 4": (decontamination.clean_stage(full, items), set()),
    }
    for name, (out, new) in runs.items():
        rows = out.collect()
        assert rows and len(set(out.columns)) == len(out.columns), name
        for r in rows:
            assert all(r[c] == f"{c}{r['doc_id']}" for c in names if c not in new), name
    # The others return their own columns, whatever the table has.
    assert lattice.score_documents(full).count() == simhash.classes(full).count() == packing.pack_documents(full).count() == 12


def test_registry():
    from veritile.llm.registry import ORACLE_SQL, QUERIES

    assert len([q for q in QUERIES if q.startswith("op")]) == 10 and "pipeline" in QUERIES
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline_keeps_one_of_each(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert 100 < docs.count() < 200


def test_pipeline_on_odd_tables(spark, odd, clashing, none):
    """Null ids, odd texts, columns of the caller, no labels and no rows go through all stages."""
    import corpus_pipeline
    from veritile.stages import materialize

    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    for docs, least in ((clashing, 3), (unlabelled, 3), (none, 0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"), name)
            assert docs.columns == columns, name
        assert docs.count() >= least
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
        assert packed.select("doc_id", "piece").distinct().count() == packed.count() >= docs.count() * (least > 0)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_long_turns_and_other_columns(spark):
    rows = [(1, 0, "user", "x" * 1_000_000, "a"), (1, 1, "assistant", "y" * 1_000_000, "b"), (2, 0, "user", "x" * 1_000_000, "c")]
    got = chat_format.render(spark.createDataFrame(rows, TURNS + ", part string").withColumn("more", F.lit(True))).collect()
    assert [(r["conv_id"], r["n_turns"], len(r["text"])) for r in got] == [(1, 2, 2_000_000 + len("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"))]

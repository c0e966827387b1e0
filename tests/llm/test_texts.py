"""Scores, tokens, counts, packing, fingerprints, rules, leaks, pages and archives."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import brown, components, decontaminate, html, packing, quality, repair, simhash, tokens, transducer, warc
from quillon.llm.common import WORD
from quillon.llm.tokens import WordIds, token_path

from .conftest import rows

RND = random.Random(4)
PARTS = ["The", "cat's", "ÉCOLE", "straße", "naïve", "x1y2", "3.14", "don't", "🙂", "中文", "<|endoftext|>", "é", "Σας", "a b", "tab\there", " ", "...", "###", "İ", "ﬁ"]
TEXTS = ["", None, " ", "\n\n", *PARTS, *(" ".join(RND.choice(PARTS) for _ in range(n)) for n in (3, 40, 400)), "word " * 3000, "z" * 5000]


# --- 2


def test_class_scores(table):
    words = [["the", "a", "one"], ["cat", "dog", "bird"], ["runs", "sits", "eats"]]
    texts = [" ".join(RND.choice(words[i % 3]) for i in range(30)) for _ in range(200)] + [None, "", "UNSEEN words here"]
    got = {r.doc_id: r for r in brown.class_scores(table(rows(texts))).collect()}
    tokens = [[w for w in WORD.findall((t or "").lower())] + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r.score < 0
    scores = [(got[i].score, got[i].base_score) for i in range(200) if held[i]]
    assert sum(s for s, _ in scores) > 0.7 * sum(b for _, b in scores)  # far better on texts that were held out


def test_likelihood_rises_until_it_stalls(table, monkeypatch):
    docs = table(rows([" ".join(f"{'abc'[i % 3]}{RND.randrange(100)}" for i in range(60)) for _ in range(100)]))
    monkeypatch.setattr(brown, "BUCKET_WORDS", 70)
    history = []
    want = [tuple(r) for r in brown.class_scores(docs, history=history).orderBy("doc_id").collect()]
    assert len(history) > 2 and all(b > a for a, b in zip(history, history[1:]))
    monkeypatch.setattr(brown, "GROUP", 1)  # counts by groups of shards are the same counts
    assert [tuple(r) for r in brown.class_scores(docs).orderBy("doc_id").collect()] == want


def test_chances_of_all_words_sum_to_one():
    """Known words, as many unseen ones as were seen once, and the end."""
    rnd = np.random.default_rng(2)
    pairs = rnd.integers(0, 9, (brown.STATES, brown.STATES))
    pairs[brown.UNKNOWN] = pairs[:, brown.UNKNOWN] = 0
    sizes, once = pairs.sum(0), 5
    model = brown.Model(pairs, int(sizes.sum()), once)
    states, counts = [], []
    for k in range(brown.CLASSES):  # each class is two words
        states += [k, k]
        counts += [int(sizes[k]) // 3, int(sizes[k]) - int(sizes[k]) // 3]
    states, counts = np.array([*states, *[brown.UNKNOWN] * once, brown.END]), np.array([*counts, *[0] * once, 7])
    for before in (0, 5, brown.END, brown.UNKNOWN):
        assert math.isclose((10 ** model.log(np.full(len(states), before), states, counts)).sum(), 1, rel_tol=1e-9)


def test_packed_counts():
    keys, n = np.array([0, 4, 300, 810, 100_000]), np.array([1, 255, 256, 700, 3])
    found = brown.unpacked(pa.chunked_array([pa.array([brown.packed(keys, n), brown.packed(keys[1:], n[1:]), brown.packed(keys[:0], n[:0])])]))
    assert [x.tolist() for x in found] == [keys.tolist(), [1, *(2 * n[1:]).tolist()]]


def test_scores_of_messy_tables(clash):
    got = brown.class_scores(clash(["a b", "a b", None, "", "z " * 50000])).collect()
    assert len(got) == 5 and got[0].score == got[0].score
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 3, 50001]


def test_transitions_are_probabilities():
    m = brown.transition_matrix(np.random.default_rng(1).integers(0, 5, (brown.STATES, brown.STATES)), 0.01)
    assert np.allclose(m.sum(1), 1) and (m > 0).all()


def test_scores_of_an_empty_table(table):
    assert brown.class_scores(table([])).count() == 0


# --- 3, 6: ids


@pytest.fixture(scope="module")
def ids():
    path = token_path("word_bpe_49k.json")
    tokenizer = WordIds(path).tokenizer
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_ids_are_the_librarys(ids):
    coder = WordIds(token_path("word_bpe_49k.json"))
    assert coder.known and [np.frombuffer(coder.encode(t or ""), "<u4").tolist() for t in TEXTS] == ids


@pytest.mark.parametrize("size", [4_000_000, 50])
def test_ids_of_arrays_are_the_librarys(size, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_BYTES", size)
    coder = WordIds(token_path("word_bpe_49k.json"))
    letters = "abcs'tremvld 019.,!<|>\n\tÉéüÿßA'''  "
    odd = "×µ你🙂́\x07\xa0"
    texts = [*TEXTS, "it's 're'll ''s x's's 'S", *("".join(RND.choice(letters + odd * (k % 2)) for _ in range(RND.randint(0, 60))) for k in range(2000))]
    want = [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = list(coder.documents(pa.array(["dropped", *texts], pa.string()).slice(1)))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    coder.known = False  # as with a file of other rules
    assert list(coder.documents(pa.array(texts, pa.string()))) == got


def test_other_files_go_to_the_library_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2, "A": 3}, [("a", "b")]))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(f"{tmp_path}/t.json")
    coder = WordIds(f"{tmp_path}/t.json")
    assert not coder.known
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.documents(pa.array(["ab Ab", None]))] == [[2, 3, 1], []]


def test_blocks_round_trip_and_random_access():
    first = 1 << 17
    docs = [(i, np.array([RND.choice([5, 6, 7, 2, 70000]) for _ in range(n)], "<u4")) for i, n in enumerate([0, 1, 2, 50, 3000])] + [(None, np.array([5, 5, 5, 5, 6], "<u4"))]
    b = repair.Block(repair.pack([(i, x.tobytes()) for i, x in docs], first), first)
    assert len(b.rules) and b.lengths.max() > 2
    assert [(i, x.tolist()) for i, x in b.all()] == [(i, x.tolist()) for i, x in docs]
    for i, (_, x) in enumerate(docs):
        assert b.document(i).tolist() == x.tolist()
        for a, z in ((0, 1), (1, 7), (len(x) // 3, max(len(x) - 1, 0)), (0, len(x)), (5, 5), (0, len(x) + 9)):
            assert b.tokens(i, a, z).tolist() == x[a:z].tolist()


def test_grammar_is_a_fixpoint_and_saves_space():
    words = [[RND.randrange(40000) for _ in range(RND.randint(1, 6))] for _ in range(300)]
    passage = [RND.randrange(40000) for _ in range(100)]
    ids = np.array([*(t for _ in range(20000) for t in words[int(RND.random() ** 3 * 300)]), *passage * 5], "<u4")
    s, rules = repair.compress(np.append(ids, repair.END), 1 << 16)
    assert repair.expand(s[:-1], rules, 1 << 16).tolist() == ids.tolist()
    left, seen, at = s[:-1].tolist(), Counter(), 0
    for a, b, c in zip([None, *left], left, left[1:]):
        seen[(b, c)] += a != b or b != c  # of a run of equal pairs one counts at least
    assert max(seen.values()) < repair.LEAST_COUNT
    assert repair.lengths_of(rules, 1 << 16).max() > 32
    assert len(repair.pack([(1, ids.tobytes())], 1 << 16)) < ids.nbytes // 4  # half of what plain u2 take


def test_pairs_that_overlap_go_by_frequency():
    s = np.array([1, 2, 3] * 4 + [1, 2] * 5 + [7, 7, 7, 7, 7, 7, 7] + [repair.END], "<u4")
    out, rules = repair.compress(s, 10)
    assert rules[0].tolist() == [1, 2] and [7, 7] in rules.tolist() and repair.expand(out[:-1], rules, 10).tolist() == s[:-1].tolist()


@pytest.mark.parametrize("width", [1, 3, 17, 33])
def test_packed_bits(width):
    x = np.array([RND.randrange(1 << width) for _ in range(70000)], np.uint64)
    data = np.frombuffer(repair.to_bits(x, width), np.uint8)
    assert len(data) == -(-len(x) * width // 8)
    for a, b in ((0, 70000), (1, 9), (65530, 65540), (5, 5)):
        assert repair.from_bits(data, width, a, b).tolist() == x[a:b].tolist()


def test_token_files(table, spark, ids, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_TOKENS", 500)
    table(rows(TEXTS)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(repair.op3_repair_tokens(spark, f"file://{tmp_path}").collect())
    at = 0
    for i, r in enumerate(got):
        own = np.array([*ids[i], 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_token_files_of_messy_tables(table, spark, tmp_path):
    """Null ids come first; rows that repeat are kept; further columns don't matter."""
    schema = "doc_id long, text string, shard int, block int, start long, n_tokens long, payload string, `a.b` string"
    data = [(i, t, 1, 1, 1, 1, "x", None) for i, t in [(None, "one"), (3, "b"), (3, "b"), (3, None), (None, None)]]
    table(data, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = repair.op3_repair_tokens(spark, f"file://{tmp_path}").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 3, 3, 3] and [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(5)]


def test_packing(table, spark, ids, tmp_path):
    table(rows(TEXTS)).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op6_vector_packing(spark, f"file://{tmp_path}").collect()
    for i in range(len(TEXTS)):
        own, at = np.array([*ids[i], 1], "<u4"), 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(own)
    for s in {r.sequence_id for r in got}:
        pieces = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048


def test_every_limit_ends_sequences():
    packer = packing.Packer(packing.Limits(200, 6, 150), 64)
    n = {i: RND.choice([3, 10, 300]) for i in range(600)}
    packer.add([(i, k, int(k * packing.PROMPT)) for i, k in n.items()])
    sequences = list(packer.drain(1))
    tokens_of = [sum(k for *_, k in s) for s in sequences]
    loss_of = [sum(max(0, k - max(0, int(n[i] * packing.PROMPT) - a)) for i, a, k in s) for s in sequences]
    assert any(x == 150 and y < 200 for x, y in zip(loss_of, tokens_of, strict=True))
    assert any(len(s) == 6 and y < 200 and x < 150 for s, x, y in zip(sequences, loss_of, tokens_of, strict=True))


def test_packer_keeps_all_limits():
    limits = packing.Limits(100, 5, 60)
    packer = packing.Packer(limits, 64)
    docs = [(i, RND.randint(1, 250), RND.randint(0, 40)) for i in range(300)]
    packer.add(docs)
    seen = {i: 0 for i, *_ in docs}
    context = {i: c for i, _, c in docs}
    sequences = list(packer.drain(1))
    for s in sequences:
        assert sum(n for *_, n in s) <= 100 and 0 < len(s) <= 5
        assert sum(max(0, n - max(0, min(context[i], dict((d[0], d[1]) for d in docs)[i]) - a) if context[i] > a else n) for i, a, n in s) <= 60
        for i, a, n in s:
            assert a == seen[i]
            seen[i] += n
    assert seen == {i: n for i, n, _ in docs}


# --- 7


PIECES = [*TEXTS, "  lead", "a  b", "▁x", "<s>", "<0x0A>", "=" * 3000, "ab" * 900, "\x00\r\n", "a" * 9001, "tionthe" * 700]


@pytest.mark.parametrize("chunk", [3, 50, 2048])
def test_counts_are_the_librarys(table, monkeypatch, chunk):
    import sentencepiece

    monkeypatch.setattr(transducer, "CHUNK", chunk)
    path = token_path(transducer.MODEL)
    model, t = sentencepiece.SentencePieceProcessor(model_file=path), transducer.Transducer(path)
    letters = "abcdehinorst  ▁.,!<>/=-0123\n\té你🙂\x00"
    texts = [x or "" for x in PIECES] + ["".join(RND.choice(letters) for _ in range(RND.randint(0, 70))) for _ in range(1500)]
    want = [len(model.encode(x)) for x in texts]
    assert t.count(texts) == want
    monkeypatch.setattr(transducer, "FEW", 0)  # array operations for any number of lanes
    assert transducer.Transducer(path).count(texts) == want
    monkeypatch.setattr(transducer, "MOST_ARCS", 10)  # begun anew for each batch
    assert [n for k in range(0, len(texts), 97) for n in t.count(texts[k : k + 97])] == want


def test_counts_of_a_table(table, spark, clash, tmp_path):
    import sentencepiece

    path = token_path(transducer.MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*PIECES, "the tion " * 900, "x" * 5000]  # several chunks
    table(rows(texts)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in transducer.op7_transducer_counts(spark, f"file://{tmp_path}").collect()}
    n = [len(model.encode(x or "")) for x in texts]
    assert got == {i: (len((x or "").encode()), n[i], n[i] > 4096) for i, x in enumerate(texts)}
    assert transducer.token_counts(clash(["a b", "a b", None]), path).count() == 3


def test_arcs_emit_changes_of_the_count():
    t = transducer.Transducer(token_path(transducer.MODEL))
    state, total, seen = t.start, 1, []
    for i, c in enumerate("then that"):
        state, n = t.step(state, int(t.symbol[ord(c)]))
        total += n
        seen.append(n)
        assert total == t.count(["then that"[: i + 1]])[0]
    assert min(seen) <= 0  # a symbol that only completes a piece


def test_state_maps_of_chunks_hang_on_their_entry():
    """A chunk without a place where it could begin anew leads from other states to other states."""
    t = transducer.Transducer(token_path(transducer.MODEL))
    symbols = t.symbol[[ord(c) for c in "======="]]
    entries = [t.initial, *(t.alone_from(t.initial, "=" * k) for k in (1, 2, 3))]
    exits, counts = t.run(symbols, np.zeros(4, np.int64), np.full(4, len(symbols)), np.array(entries))
    assert len(set(exits.tolist())) > 1 and len(set(counts.tolist())) > 1


def test_scan_is_sequential_composition():
    maps = [{0: (RND.randrange(3), RND.randrange(9)), 1: (RND.randrange(3), 1), 2: (RND.randrange(3), 2)} for _ in range(13)]
    got = transducer.scan(maps)
    for entry in range(3):
        state, total = entry, 0
        for k, m in enumerate(maps):
            state, total = m[state][0], total + m[state][1]
            assert got[k][entry] == (state, total)


# --- 10


def brute_fingerprint(text, size=4):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_repair_rounds_at_the_least_bound_look_at_what_changed(monkeypatch):
    rnd = random.Random(12)
    words = [[rnd.randrange(40) for _ in range(rnd.randint(2, 40))] for _ in range(300)]
    s = np.array([x for _ in range(1500) for x in (*rnd.choice(words), repair.END)], np.uint32)
    seen, count = [], repair.counted_pairs

    def spied(s, bound, least, *only):
        found = count(s, bound, least, *only)
        seen.append((found[0], len(only[0]) if only and only[0] is not None else len(s)))
        whole = count(s, found[0], least)
        assert all(np.array_equal(x, y) for x, y in zip(found[1:], whole[1:], strict=True))
        return found

    monkeypatch.setattr(repair, "counted_pairs", spied)
    out, rules = repair.compress(s, 1 << 16)
    assert np.array_equal(repair.expand(out[out != repair.END], rules, 1 << 16), s[s != repair.END])
    last = [n for bound, n in seen if bound == repair.LEAST_COUNT]
    assert len(last) > 2 and max(last[1:]) < last[0] and last[-1] < last[0] / 20


def test_simhash_classes(table):
    base = [[f"w{RND.randrange(500)}" for _ in range(300)] for _ in range(20)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:k], "NEW", *b[k + 1 :]]) for b in base for k in (0, 299)] + [" ".join(base[0])] * 3 + [None, "", "one", "ONE"]
    got = {r.doc_id: r for r in simhash.classes(simhash.fingerprints(table(rows(texts)), 4)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == fps
    least = list(range(len(texts)))
    for _ in range(len(texts)):
        least = [min(least[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(texts))]
    assert [got[i].component_id for i in range(len(texts))] == least


def test_one_of_each_keeps_clean_documents(table, clash):
    base = [[f"v{RND.randrange(3000)}" for _ in range(400)] for _ in range(15)]
    near = [[*b[:k], "x", *b[k + 1 :]] for b, k in zip(base[:5], (50, 100, 150, 200, 250), strict=True)]
    texts = [" ".join(b) for b in base + near + base[:3]]
    kept = sorted(r.doc_id for r in simhash.one_of_each(table(rows(texts))).collect())
    assert kept == list(range(15))
    df = clash([*texts[:2], texts[0], None, ""])
    out = simhash.one_of_each(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [0, 1, 3]


def test_a_sketch_goes_to_few_buckets_a_table_however_many_there_are(spark, monkeypatch):
    """Links are those of all pairs with at most two differing bits in a table, in any number of buckets."""
    rng = np.random.default_rng(9)
    fps = rng.integers(0, 1 << 63, (300, simhash.HASHES)).astype(np.uint64)
    for k in range(0, 300, 3):
        fps[k + 1] = fps[k]
        for b in simhash.table_bits(k % simhash.TABLES)[: 1 + k % 4].tolist():
            fps[k + 1, b >> 6] ^= np.uint64(1 << (b & 63))
    masks = np.array([0, *(1 << i for i in range(simhash.SHORT))], np.uint64)
    short = [simhash.shorts(fps, t) for t in range(simhash.TABLES)]
    want = {(a, b) for x in short for a, b in np.argwhere(np.bitwise_count(x[:, None] ^ x[None]) <= 2).tolist() if a < b and np.bitwise_count(fps[a] ^ fps[b]).sum() <= simhash.MOST_DIFFERENT * simhash.SKETCH}
    df = spark.createDataFrame([(i, *map(int, f.view(np.int64))) for i, f in enumerate(fps)], "id long, " + ", ".join(f"{c} long" for c in simhash.FPS))
    for size in (250_000, 300, 20):
        monkeypatch.setattr(simhash, "TABLE_BUCKET", size)
        links = simhash.met_tables(df, 20)
        assert {(min(r), max(r)) for r in map(tuple, links.collect())} == want
    for cut in (3, 10):
        _, who = simhash.placed(short[0], masks, cut)
        assert np.bincount(who).tolist() == [cut + 1] * 300  # one a variant, 33, before


def test_what_a_stage_has_written_for_itself_is_gone(table):
    from quillon.sources.shared import shared_dir

    df = table(rows([f"{' '.join(f'w{i}' for i in range(90))} x{k}" for k in range(6)]))
    folder = shared_dir(df.sparkSession).removeprefix("file://")
    before = set(os.listdir(folder))
    assert len({r.root for r in simhash.near_classes(df).collect()}) == 1
    left = {x.split("-")[0] for x in set(os.listdir(folder)) - before}
    assert not left & {"shingled", "sketches", "members", "links"}


def test_near_duplicates_are_similar(table):
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(10**6)}"
    texts = []
    for k in range(240):
        text = [word() for _ in range(404)]
        # One run of n other words changes n + 4 of 400 shingles: 44 leave a similarity of 0.802, 58 of 0.732.
        n = 40 if k < 160 else 54
        texts += [" ".join(text), " ".join([*text[:100], *(word() for _ in range(n)), *text[100 + n :]])]
    root = {r.doc_id: r.root for r in simhash.near_classes(table(rows(texts))).collect()}
    joined = [root[2 * k] == root[2 * k + 1] for k in range(240)]
    assert sum(joined[:160]) >= 157 and not any(joined[160:])
    # A line that is repeated over and over doesn't make different texts alike.
    line = "all rights are reserved here " * 200
    assert len({r.root for r in simhash.near_classes(table(rows([line + t for t in texts[:40:2]]))).collect()}) == 20


def brute_classes(sets, least=0.8):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def test_near_classes_of_a_large_group_are_those_of_all_its_pairs(table, monkeypatch):
    """Copies of one text, of which few have a neighbour and hardly any the same one."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rnd = random.Random(31)
    base, texts = [f"w{rnd.randrange(10**6)}" for _ in range(300)], []
    for _ in range(150):
        one = list(base)
        for _ in range(rnd.randint(1, 4)):
            at, n = rnd.randrange(270), rnd.randint(8, 20)
            one[at : at + n] = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        texts.append(one)
        if rnd.random() < 0.3:
            at = rnd.randrange(280)
            texts.append([*one[:at], *(f"x{rnd.randrange(10**6)}" for _ in range(12)), *one[at + 12 :]])
    rnd.shuffle(texts)
    want = brute_classes([{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts])
    got = {r.doc_id: r.root for r in simhash.near_classes(table(rows([" ".join(t) for t in texts]))).collect()}
    first = {}
    assert [first.setdefault(got[i], i) for i in range(len(texts))] == want
    assert len(set(want)) > 20 and max(Counter(want).values()) > 20


def test_all_pairs_of_a_large_group_that_meets_are_linked(spark, monkeypatch):
    """Twenty pairs of sketches meet in the first table only, all in one group."""
    monkeypatch.setattr(simhash, "TABLES", 4)
    rng = np.random.default_rng(5)
    first = simhash.table_bits(0)
    common, data = rng.integers(0, 2, len(first)), []
    for k in range(20):
        one = rng.integers(0, 2, simhash.SKETCH)
        one[first] = common
        other = one.copy()
        for t in range(1, simhash.SKETCH // simhash.SHORT):  # eight bits of each further table: too many to meet there
            other[simhash.table_bits(t)[:8]] ^= 1
        for i, x in enumerate((one, other)):
            data.append((2 * k + i, *np.packbits(x.astype(np.uint8), bitorder="little").view("<i8").tolist()))
    df = spark.createDataFrame(data, "id long, " + ", ".join(f"{c} long" for c in ["fp", *(f"fp{k}" for k in range(1, simhash.HASHES))]))
    links = {tuple(sorted((r.u, r.v))) for r in simhash.met_tables(df, 4).collect()}
    assert {(2 * k, 2 * k + 1) for k in range(20)} <= links


def test_alike_sets_are_those_of_brute_force():
    rnd = random.Random(7)
    for _ in range(40):
        sets = [set(rnd.sample(range(14), rnd.randint(1, 10))) for _ in range(rnd.randint(1, 25))] + [set()] * rnd.randint(0, 1)
        root = list(range(len(sets)))
        for a, b in simhash.alike([np.array(sorted(x), np.uint64) for x in sets], 0.8).tolist():
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
        assert root == brute_classes(sets)


@pytest.mark.parametrize("chunk", [3, 40, 10**6])
def test_components_are_those_of_union_find(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rnd = random.Random(chunk)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 360)] + [(5, 5), (-7, 9)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    want = {i: find(i) for i in root if find(i) != i}
    df = spark.createDataFrame(edges + edges[:9], "u long, v long").repartition(9)
    assert {r.u: r.root for r in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0


def test_simhash_of_an_empty_table(table):
    assert simhash.classes(simhash.fingerprints(table([]), 4)).count() == 0
    assert simhash.one_of_each(table([])).count() == 0


# --- 5


def test_quality_measures_and_verdicts(table):
    good = " ".join(f"word{i}" for i in range(60))
    texts = [good, "few words", None, "", "a b c " * 40, good + "\nsame\nsame\n \nsame", good.replace(" ", " ### ")]
    got = {r.doc_id: r for r in quality.host_rules(table(rows(texts)), carry=("doc_id",)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        g = Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (got[i]._q_n_words, got[i]._q_word_chars, got[i]._q_n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert (got[i]._q_n_dup_lines, got[i]._q_n_symbols) == (len(lines) - len(set(lines)), sum(c in "#*$%&|<>" for c in t or ""))
    assert [got[i]._q_kept for i in range(5)] == [True, False, False, False, False]


def test_bad_hosts_don_t_cost_clean_documents(table):
    clean = " ".join(f"word{i}" for i in range(80))
    noisy = " ".join(f"word{i} ###" for i in range(80))
    data = [(i, noisy if i < 300 and i % 10 else clean + f" n{i}", "en", "bad" if i < 300 else f"h{i % 7}", 0) for i in range(600)]
    got = {r.doc_id: r._q_kept for r in quality.host_rules(table(data), carry=("doc_id",)).collect()}
    assert all(got[i] for i in range(600) if i >= 300 or i % 10 == 0)
    assert not any(got[i] for i in range(300) if i % 10)


def test_quality_stage(clash, table):
    df = clash([" ".join(f"word{i}" for i in range(60)), "x", None])
    out = quality.filter_stage(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [0]
    assert quality.filter_stage(table([])).count() == 0


def test_beta_prior():
    a, b = quality.beta_prior(0.25, 0.01)
    assert math.isclose(a / (a + b), 0.25) and math.isclose(a + b, 0.25 * 0.75 / 0.01 - 1)
    assert quality.beta_prior(None, None) == (0.5, 0.5)


# --- 8


ITEM = "A train leaves Paris at 10 km per hour and meets Alice after 25 minutes, then Alice rides 25 minutes more to the town."


def test_leaks(table, spark, clash):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")
    texts = [
        f"before that. {ITEM} and after",
        "x A train leaves London at 17 km per hour and meets Bob after 40 minutes, then Bob rides 40 minutes more to the town.",
        "A train leaves London at 17 km per hour and meets Bob after 40 minutes, then Carol rides 41 minutes more to the town.",
        "a train of thought leaves the town", None, "", ITEM.lower(),
    ]
    got = {(r.doc_id, r.item_id): r.changed for r in decontaminate.leaks(table(rows(texts)), bench).collect()}
    assert (0, 1) in got and (1, 1) in got and got[0, 1] is False and got[1, 1] is True
    assert {d for d, _ in got} <= {0, 1, 6}
    df = clash(texts)
    out = decontaminate.clean_stage(df, bench)
    assert out.columns == df.columns and {2, 3, 4, 5} <= {r.doc_id for r in out.collect()}
    assert decontaminate.leaks(table([]), bench).count() == 0
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0


@pytest.fixture(scope="module")
def held(table, spark):
    """The pairs of document and item, and whether values differ at the first path's places."""

    def find(items, texts):
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        found = {}
        for r in decontaminate.leaks(table(rows(texts)), bench).collect():
            found.setdefault((r.doc_id, r.item_id), []).append((r.n_covered, r.n_item, r.changed))
        return found

    return find


def test_verbatim_copies(held):
    sums, short = "Compute 17 + 25 * 3 - 48 / 6 + 91 * 2 - 14", "What is the capital of France?"
    got = held([sums, short, ITEM], [f"so {sums} ok", f"see 3) {short}", ITEM.upper(), ITEM.lower(), "Compute 1 + 2 * 3 - 4 / 5 + 6 * 7 - 8", "what is it of France"])
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 0)}  # the sum also with other numbers


def test_other_values(held):
    eggs = "A farmer has 12 eggs for 5 dollars and sells 8 hens for 30 dollars to the man who lives near the old town"
    cow = "A farmer has 12 eggs and pays 5 for each hen and then 30 for a cow when Bob comes to town with Ann"
    texts = [
        eggs.replace("8", "5").replace("12", "5"), cow.replace("12", "1,200").replace("5", "5.50").replace("30", "30.25"),
        cow.replace("Bob", "Mary Jane").replace("Ann", "Tom Brown"), cow.replace(" hen ", " big hen ").replace(" cow ", " brown cow "),
        "A farmer has 5 dollars", cow + " " + cow.replace("12", "13").replace("Bob", "Tom"),
    ]
    got = held([eggs, cow], texts)
    assert set(got) == {(0, 0), (1, 1), (2, 1), (3, 1), (5, 1)}
    assert all(max(got[k])[0] == max(got[k])[1] for k in [(0, 0), (1, 1), (2, 1), (5, 1)])
    sums = "Compute 17 + 25 * 3 - 48 / 6 + 91 * 2 - 17"  # mostly numbers; the first and the last are one value
    other = ["Compute 18 + 26 * 4 - 49 / 7 + 92 * 3 - 18", "now compute 1, 2, 3, 4 and 5", "the numbers 18 26 4 49 7 92 3 18 are in a row", "Add 18 + 26 * 4 - 49 / 7 + 92 * 3 - 18"]
    assert set(held([sums], other)) == {(0, 0)}
    assert held(["He has 7 eggs, 7 hens and 7 cows to sell in the town"], ["He has 8 eggs, 9 hens and 10 cows to sell in the town"]) == {}


# --- 4

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><nav><a href=x>Home</a></nav></header>
<div class="cookie-notice">We use cookies on this site, is that all right with you?</div>%s<aside>A side bar with quite a long text in it, too</aside>
<div class="comments"><p>I like this article very much indeed, thanks a lot for it</p></div><script>var x = "<p>no</p>";</script><footer>&copy; foot</footer></body></html>"""


@pytest.mark.parametrize("holder", ["<article>%s</article>", "<div id=main-content>%s</div>", "<main>%s</main>"])
def test_main_text(holder):
    inner = "<h2>Head  line</h2><p>First para of the text &amp; more\n words here.<p>Second &#8212; one <a href=y>link</a> <b>inside</b> of it.</p><p>Short.</p><form><p>Subscribe</p></form>"
    assert html.main_text(PAGE % (holder % inner)) == "Head line\nFirst para of the text & more words here.\nSecond — one link inside of it.\nShort."


def test_clusters_choose_the_region(monkeypatch):
    """No article or main element, no names: with other clusters the text is another."""
    long = " ".join(["some words of the article which go on"] * 8)
    page = f"""<html><body><div><div>My site</div><div>Wed 3</div><div>A</div></div><div><div><h2>Title</h2><p>{long}</p><p>Short one.</p><p>{long}</p></div>
    <div><div>Next</div><div>More</div><div>Top</div></div></div><div><div>(c)</div><div>us</div></div></body></html>"""
    want = "\n".join(["Title", long, "Short one.", long])
    assert html.main_text(page) == want
    monkeypatch.setattr(html, "content", lambda blocks: [True] * len(blocks))
    every = html.main_text(page)
    assert every != want and "My site" in every and "(c)" in every
    monkeypatch.setattr(html, "content", lambda blocks: [b.text == "Short one." for b in blocks])
    assert html.main_text(page) == want  # any part of the region leads to all of it
    monkeypatch.setattr(html, "content", lambda blocks: [b.text in ("My site", "Wed 3") for b in blocks])
    assert html.main_text(page) == "My site\nWed 3\nA"


@pytest.mark.parametrize("shell", ["<div>{}</div>", "<section><div>{}</div></section>", "<table><tr><td>{}</td></tr></table>", "<center>{}</center>"])
def test_pages_without_a_region(shell):
    """Words of the page's text against those of the article: nothing lost, nothing gained."""
    paragraphs = [" ".join(RND.choice(["stone", "water", "light", "wind", "tree"]) for _ in range(RND.randint(15, 60))) + "." for _ in range(9)] + ["Yes.", "And so on."]
    RND.shuffle(paragraphs)
    article = "<h1>About stones</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    menu = "".join(f'<div><a href="/{k}">go {k}</a></div>' for k in range(9))
    page = f"<body><div>{menu}</div>{shell.format(article)}<div><div>Imprint</div><div>Terms</div><div>Help</div></div></body>"
    assert html.main_text(page) == "\n".join(["About stones", *paragraphs])


def test_extraction_of_messy_tables(spark, tmp_path):
    schema = "page_id long, url string, html string, text string, path string, `a.b` int"
    data = [(1, "u", "<p>one</p>", "x", "y", 1), (1, "u", "<p>one</p>", "x", "y", 1), (None, None, None, None, None, None), (2, "v", "", "x", "y", 2)]
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html.op4_html_text(spark, f"file://{tmp_path}").collect())
    assert got == [(0, None, "", 0), (1, "u", "one", 3), (1, "u", "one", 3), (2, "v", "", 0)]


def test_odd_pages(table):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain & simple"), (4, "u", "<p><b>a<p>c</i></article>"), (5, "u", "<" * 50), (6, "u", "<p>" + "long " * 20000)]
    got = {r.page_id: r.text for r in html.extracted(table(pages, "page_id long, url string, html string")).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("", "", "plain & simple", "a\nc") and len(got[6]) == 20000 * 5 - 1


def test_holder_keeps_all_paragraphs():
    a, b, c = (" ".join([w] * n) for w, n in (("one", 12), ("two", 12), ("three", 330)))
    assert html.main_text(f"<body><div><h2>Head</h2><p>{a}</p><p>{b}</p><p>{c}</p></div></body>") == f"Head\n{a}\n{b}\n{c}"
    assert html.main_text(f"<body><div class=intro><p>{b}</p></div><div><p>{c}</p></div></body>") == f"{b}\n{c}"
    teaser, body = " ".join(["teaser"] * 70), " ".join(["body"] * 180)
    assert body in html.main_text(f"<body><article><p>{teaser}</p></article><div><p>{body}</p></div></body>")


def test_articles_aren_t_set_apart():
    body = "\n".join(" ".join([w] * 60) for w in ("one", "two", "three"))
    inner = "".join(f"<p>{line}</p>" for line in body.split("\n"))
    for name in ("content has-sidebar", "no-sidebar", "share-enabled", "elementor-widget-container", "widget"):
        assert html.main_text(PAGE % f"<div class='{name}'>{inner}</div>") == body
    assert html.main_text(f"<body><form action=x><input name=y><label>Label</label>{inner}</form></body>") == body
    parts = "".join(f"<div class=widget><p>{line}</p></div>" for line in body.split("\n"))
    assert html.main_text(f"<body><h1>Left over</h1>{parts}</body>") == "Left over\n" + body
    assert "x = 2" in html.main_text(f"<article><p>Here is <math><mi>x</mi> = <mn>2</mn></math></p>{inner}</article>")
    apart = "".join(f"<div class='{c}'><p>{'noise ' * 30}</p></div>" for c in ("site-footer", "cookie-notice", "main-nav", "postComments"))
    assert html.main_text(f"<body>{apart}<div>{inner}</div><div class=comments>{'<p>' + 'said ' * 900}</div></body>") == body


# --- 9


def test_archives(table, spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1\r\n" * 500
    pages = [(1, "http://a/ b", big), (2, None, big), (3, "c", "x"), (4, "d", None), (5, "e", ""), (6, "f", big), (6, "f", big), (None, "g", "x")]
    df = table(pages, "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w")
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter([(1, "revisit", 6), (2, "revisit", 6), (6, "response", None), (6, "revisit", 6), (3, "response", None), (None, "revisit", 3), (4, "revisit", 5), (5, "response", None)])
    assert {r.payload_bytes for r in got if r.page_id in (1, 2, 6)} == {len(big.encode())}
    warc.write_archives(df, f"file://{tmp_path}/v", least_bytes=2)
    assert Counter(r.record_type for r in warc.read_archives(spark, f"file://{tmp_path}/v").collect()) == {"response": 5, "revisit": 3}
    warc.write_archives(df.limit(0), f"file://{tmp_path}/e")


def _archives(path):
    import gzip

    return [list(warc.records(gzip.open(f))) for f in sorted(path.glob("*.gz"))]


def test_archives_are_bounded_and_headers_fresh(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    schema = "page_id long, url string, html string, record string, bytes long, digest string, o int"
    spark.createDataFrame([(i, f"http://x/{i}", f"page {i % 60} " * 300, "r", 1, "d", 2) for i in range(100)], schema).write.parquet(f"{tmp_path}/pages.parquet")
    warc.write_archives(spark.read.parquet(f"file://{tmp_path}/pages.parquet"), f"file://{tmp_path}/w")
    files = _archives(tmp_path / "w")
    assert len(files) > 5 and all(sum(len(b) for _, b in f) < 100_000 for f in files)
    ids = {}
    for f in files:
        assert [h["WARC-Type"] for h, _ in f].count("warcinfo") == 1 and f[0][0]["WARC-Type"] == "warcinfo"
        ids |= {h["WARC-Record-ID"]: h for h, _ in f}
    for h in ids.values():
        assert not h["WARC-Date"].startswith("1970")
        if h["WARC-Type"] == "revisit":
            to = ids[h["WARC-Refers-To"]]
            assert to["WARC-Type"] == "response" and (to["WARC-Payload-Digest"], to["WARC-Date"], to["WARC-Target-URI"]) == (h["WARC-Payload-Digest"], h["WARC-Refers-To-Date"], h["WARC-Refers-To-Target-URI"])


def test_revisits_are_held_against_their_originals(spark, tmp_path):
    import gzip

    rows_ = [(1, "u", "one"), (2, "v", "one")]
    warc.write_archives(spark.createDataFrame(rows_, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    for f in (tmp_path / "w").glob("*.gz"):
        text = gzip.open(f).read()
        at = text.find(b"WARC-Type: revisit")
        if at >= 0:
            k = text.index(b"sha1:", text.index(b"WARC-Payload-Digest", at)) + 5
            text = text[:k] + (b"A" if text[k : k + 1] != b"A" else b"B") + text[k + 1 :]
            (tmp_path / "w" / f".{f.name}.crc").unlink(missing_ok=True)
            f.write_bytes(gzip.compress(text))
    with pytest.raises(ValueError, match="differs"):
        warc.read_archives(spark, f"file://{tmp_path}/w")


def test_base32():
    import base64
    import hashlib

    want = base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    from pyspark.sql import SparkSession

    assert SparkSession.getActiveSession().range(1).select(warc.base32_sha1(F.lit("abc"))).first()[0] == want


def test_messy_columns_reach_every_operator(clash, spark):
    """Nulls, empty and long texts, repeated rows and columns named like our own."""
    texts = [None, "", "z" * 3000, "a b c d e f", "a b c d e f", "word " * 500]
    df = clash(texts)
    n = len(texts)
    assert brown.class_scores(df).count() == n
    assert packing.packed(df, token_path("word_bpe_49k.json"), 1).select("doc_id").distinct().count() == n
    assert transducer.token_counts(df, token_path(transducer.MODEL)).count() == n
    assert simhash.classes(simhash.fingerprints(df, 4)).count() == n
    assert quality.host_rules(df, carry=("doc_id",)).count() == n
    repeated = df.union(df)  # a plan over files: rows are told apart by scan
    assert quality.host_rules(repeated, carry=("doc_id",)).count() == 2 * n
    assert simhash.one_of_each(repeated).count() == 4


def test_empty_tables(table, spark, tmp_path):
    df = table([])
    assert transducer.token_counts(df, token_path(transducer.MODEL)).count() == 0
    assert packing.packed(df, token_path("word_bpe_49k.json"), 1).count() == 0
    assert quality.host_rules(df).count() == 0
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert repair.op3_repair_tokens(spark, f"file://{tmp_path}").count() == 0
    pages = table([], "page_id long, url string, html string")
    assert html.extracted(pages).count() == 0
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op9_warc_revisits(spark, f"file://{tmp_path}").count() == 0

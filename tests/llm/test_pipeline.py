"""The pipeline on planted cases, and the registry."""

import random
import re
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np

from quillon.llm import quality, registry, simhash
from quillon.llm.packing import VOCABULARY
from quillon.llm.tokens import WordIds, token_path

from .conftest import rows


def test_planted_cases(table, spark, tmp_path):
    rnd = random.Random(9)
    text = lambda n: " ".join(f"{rnd.choice('bcdfgklmnprst')}{rnd.choice('aeiou')}{rnd.randrange(4000)}" for _ in range(n))
    item, passage = text(40), text(80)
    clean = [text(120) for _ in range(30)]
    words = clean[0].split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    docs = [*clean, clean[1], near, "too short", text(80) + " " + item + " " + text(30), *(f"{text(90)} {passage} {text(90)}" for _ in range(3))]
    table(rows(docs)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf_dir = f"file://{tmp_path}"
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf_dir)
        if name != "packing":
            assert out.columns == df.columns
        path = f"{sf_dir}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        df = spark.read.parquet(path)
        kept.append({r.doc_id for r in df.collect()})
    assert kept[0] == set(range(len(docs))) - {32}
    assert kept[1] == kept[0] - {30, 31}
    third = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/suffix-array-dedup").collect()}
    assert all(passage not in third[i] for i in (34, 35, 36)) and all(third[i] == clean[i] for i in range(30))
    assert kept[3] == kept[2] - {33}
    assert kept[4] == kept[3]


def test_registry_names():
    numbers = {int(n[2:].split("_")[0]) for n in registry.QUERIES}
    assert numbers == set(range(1, 11)) and set(registry.ORACLES) <= set(registry.QUERIES)


# --- against a brute-force version of every stage


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def alike(a, b):
    return (len(a & b) >= 0.8 * len(a | b)) if a | b else True


def classes(texts):
    """The least id that links of similarity 0.8 reach."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if alike(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def without_repeats(texts, length):
    data = {i: (t or "").encode() for i, t in texts.items()}
    n, out = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1)), {}
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if n[b[k : k + length]] > 1:
                gone[k : k + length] = True
        out[i] = bytes(np.frombuffer(b, np.uint8)[~gone]).decode(errors="ignore")
    return out


def holds(text, item, window=8, share=0.5):
    """Whether half of the item's words stand in the text at one offset, in windows of eight."""
    a, b = (re.findall(r"[^\W_]+", x.lower()) for x in (text, item))
    size = min(window, len(b))
    covered = {}
    for p in range(len(a) - size + 1):
        for q in range(len(b) - size + 1):
            if a[p : p + size] == b[q : q + size]:
                covered.setdefault(p - q, set()).update(range(q, q + size))
    return any(len(x) >= share * len(b) for x in covered.values())


def test_stages_are_those_of_brute_force(table, spark, tmp_path):
    rnd = random.Random(21)
    vocabulary = ["".join(rnd.choice("bcdfgklmnprstaeiou") for _ in range(rnd.randint(3, 8))) for _ in range(900)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items, passages = [text(20) for _ in range(3)], [text(70) for _ in range(2)]
    docs = [text(rnd.randint(55, 160)) for _ in range(25)]
    for k in range(12):  # near copies of falling similarity
        w = docs[k].split()
        for _ in range(k // 2):
            w[rnd.randrange(len(w))] = "other"
        docs.append(" ".join(w))
    docs += [f"{text(60)} {passages[k % 2]} {text(40)}" for k in range(6)]
    docs += [f"{text(50)} {items[k % 3]} {text(30)}" for k in range(4)] + [f"{text(50)} {' '.join(items[0].split()[:9])} {text(30)}"]
    docs += [None, "", "few words only", "same same same " * 40, "## " * 60, *(f"line\n{text(3)}\nline\nline\n{text(60)}" for _ in range(3))]
    rnd.shuffle(docs)
    table(rows(docs)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    result = con.execute(quality.ORACLE_SQL)
    columns = [c[0] for c in result.description]
    want = {r[columns.index("doc_id")]: docs[r[columns.index("doc_id")]] for r in result.fetchall() if r[columns.index("kept")]}
    assert 30 < len(want) < len(docs)
    kept = [want]
    of = classes(want)
    kept.append({i: t for i, t in want.items() if of[i] == i})
    kept.append(without_repeats(kept[-1], corpus_pipeline.PASSAGE_BYTES))
    kept.append({i: t for i, t in kept[-1].items() if not any(holds(t, x) for x in items)})
    assert len(kept[3]) < len(kept[2]) == len(kept[1]) < len(kept[0]) and any(kept[2][i] != kept[1][i] for i in kept[1])
    df = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for (_, stage), wanted in zip(corpus_pipeline.STAGES, kept, strict=False):
        df = stage(spark, df, f"file://{tmp_path}")
        df.write.parquet(path := f"file://{tmp_path}/{stage.__name__}")
        df = spark.read.parquet(path)
        assert {r.doc_id: r.text for r in df.collect()} == wanted, stage.__name__
    coder, pieces = WordIds(token_path(VOCABULARY)), {}
    for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for i, t in kept[3].items():
        assert b"".join(x for _, x in sorted(pieces.pop(i))) == coder.library(t) + np.array([1], "<u4").tobytes()
    assert not pieces


def test_stages_on_messy_and_empty_tables(clash, spark, tmp_path):
    clean = " ".join(f"word{i * 7919 % 997}" for i in range(80))
    df = clash([clean, clean, None, "", clean.replace("word", "term")])
    spark.createDataFrame([(1, None), (None, "an item of some words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, f"file://{tmp_path}")
        if name != "packing":
            assert out.columns == df.columns
            assert {r.doc_id for r in out.collect()} <= {0, 1, 2, 3, 4}
        assert {0, 4} <= {r.doc_id for r in out.collect()}
        none = stage(spark, df.limit(0), f"file://{tmp_path}")
        assert none.count() == 0
    empty = tmp_path / "empty"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    decontaminated = dict(corpus_pipeline.STAGES)["benchmark decontamination"](spark, df, f"file://{empty}")
    assert decontaminated.count() == 5


def test_near_duplicates_of_the_tables_are_found(spark):
    """Texts whose id is divisible by ten against all, by brute force."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in df.select("doc_id", "text").collect()}
    root = {r.doc_id: r.root for r in simhash.near_classes(df).collect()}
    pairs = [(i, j) for i in sets if i % 10 == 0 for j in sets if i != j and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and alike(sets[i], sets[j])]
    assert len(pairs) > 10 and sum(root[i] == root[j] for i, j in pairs) >= 0.99 * len(pairs)

"""The pipeline against plain versions of its stages, and the registered queries against SQL."""

import random

import pytest

import corpus_pipeline
from compare import same
from semloom.llm import quality, queries, tokens
from test_operators import VOCABULARY, check_packing, components_brute, decontamination_brute, lines_brute, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, empty and repeated rows, near copies, shared chunks, benchmark texts and junk."""
    rng = random.Random(21)
    base = [prose(rng, 70, 3000) for _ in range(12)]
    block = [prose(rng, 8, 3000) for _ in range(24)]
    items = [(i, prose(rng, 25, 3000)) for i in range(4)] + [(4, None)]
    rows = [(i, t) for i, t in enumerate(base)] + [(50, None), (51, ""), (52, "few words"), (None, base[1]), (3, base[3])]
    for i in range(6):
        words = base[i].split()
        words[5] = rng.choice(VOCABULARY)
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, "\n".join([prose(rng, 30, 3000), *block, prose(rng, 30, 3000)])) for i in range(3)]
    rows += [(300 + i, prose(rng, 50, 3000) + " " + items[i][1]) for i in range(3)]
    rows += [(400 + i, prose(rng, 80, 3000)) for i in range(30)]
    rows += [(500 + i, " ".join(w.upper() + "!!" for w in prose(rng, 80, 3000).split())) for i in range(30)]
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "extra") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(d, int(d < 500), 0) for d, _ in rows if d is not None and d >= 400], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, items


def read(df):
    return sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=repr)


def test_stages_and_result(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "jaccard_join", "benchmark_decontamination", "packing"]

    model = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    verdict = {(r["doc_id"]): r["kept"] for r in quality.score(docs, model).collect()}
    one = stages["quality_rules"](spark, docs, path)
    want = sorted([(d, t) for d, t in rows if verdict[d]], key=repr)
    assert one.columns == docs.columns and read(one) == want
    assert not any(d is not None and d >= 500 or d in (50, 51, 52) for d, _ in want)

    two = stages["line_dedup"](spark, one, path)
    done = lines_brute(want)
    want = sorted([(d, t) for d, _, gone, t in done if not gone or (t or "").split()], key=repr)
    assert two.columns == docs.columns and read(two) == want
    assert sum(x[2] for x in done) > 10
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())

    three = stages["jaccard_join"](spark, two, path)
    labels = {x[0]: x[2] for x in components_brute(want, 5, 80) if x[0] is not None}
    kept = {d for d, c in labels.items() if d == c}
    want = sorted({(d, t) for d, t in want if d in kept}, key=repr)
    assert three.columns == docs.columns and read(three) == want
    assert not kept & set(range(100, 106))

    four = stages["benchmark_decontamination"](spark, three, path)
    bad = {r[0] for r in decontamination_brute(want, items) if r[5]}
    want = [(d, t) for d, t in want if d not in bad]
    assert bad == {300, 301, 302} and four.columns == docs.columns and read(four) == want

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.model_path("word_bpe_49k.json"))
    found = corpus_pipeline.run(spark, path).collect()
    check_packing(want, found, lambda t: library.encode(t, add_special_tokens=False).ids)
    assert {r["doc_id"] for r in found} == {d for d, _ in want}


def test_stages_take_empty_tables(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0, name
        docs = out if out.columns == docs.columns else docs


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), sf, queries.oracle_sql()[name])


def test_one_query_per_operator():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))

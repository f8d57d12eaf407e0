import os

import pytest

import corpus_pipeline as P
from test_dedup import brute_shingles, group, star

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == ids


def test_odd_rows(spark):
    long = "word " * 60
    rows = [(1, long, "en", "s", 300), (1, long, "en", "s", 300), (2, None, None, None, None), (None, long, "en", "s", 300), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in P.drop_copies(spark, docs, SF).collect()) == ["1", "3", "None"]
    cut = {r.doc_id: r for r in P.cut_repeats(spark, docs.dropDuplicates(["doc_id"]), SF).collect()}
    assert cut[2].text is None and cut[1].n_chars == len(cut[1].text) < 300
    for stage in (P.drop_toxic, P.drop_copies, P.drop_near_copies, P.cut_repeats, P.pack):
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_a_reused_id_takes_no_other_row_along(spark):
    words = [f"w{k}" for k in range(60)]
    near, clean = " ".join(words[:-1]), "a text of its own that nothing else is like"
    rows = [(1, "copied"), (1, "apart"), (1, "apart"), (1, None), (1, ""), (2, "copied"), (None, "copied")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r.doc_id, r.text or "") for r in P.drop_copies(spark, docs, SF).collect()]
    assert sorted(left, key=str) == sorted([(1, "apart"), (1, ""), (2, "copied"), (None, "copied")], key=str)
    docs = spark.createDataFrame([(0, " ".join(words)), (5, near), (5, clean), (7, None), (7, "")], "doc_id long, text string")
    left = [tuple(r) for r in P.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(left, key=str) == sorted([(0, " ".join(words)), (5, clean), (7, None), (7, "")], key=str)


def test_cut_keeps_the_text_s_own_signs(spark):
    own = "\ufffd and \ufdd0 \ufdd01 é\ufffd "
    passage = "".join(f"é{k}" for k in range(80))
    rows = [(1, "a" + passage + "b", 5), (2, own + passage[1:] + "z" + own, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in P.cut_repeats(spark, docs, SF).collect()}
    assert got == {1: rows[0][1], 2: own + "z" + own}


def test_run_against_brute_force(spark, tmp_path, monkeypatch):
    texts = star()
    other = [f"text {i} " + " ".join(f"y{i}z{k}" for k in range(40)) for i in range(20)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, t) for i, t in enumerate([*texts[1:], *other, *other[:5], *(f"{o} {passage}" for o in other[10:14])])] + [(9000, texts[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    paths, new_path = [], P.new_path
    monkeypatch.setattr(P, "new_path", lambda *a: paths.append(new_path(*a)) or paths[-1])
    packed = P.run(spark, str(tmp_path)).collect()
    stages = [{r.doc_id: r.text for r in spark.read.parquet(p).collect()} for p in paths[:4]]
    assert stages[0] == dict(rows)
    last = {t: i for i, t in sorted(rows)}
    left = {i: t for t, i in last.items()}
    assert stages[1] == left
    sets = {i: brute_shingles(t) for i, t in left.items()}
    whole = group([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], sets)
    left = {i: t for i, t in left.items() if whole[i] == i}
    assert stages[2] == left and sum(i < 450 or i == 9000 for i in left) == 1
    seen, cut = set(), {}
    for i, t in sorted(left.items()):
        gone = [False] * len(t)
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(t[k : k + 100])
        cut[i] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    assert stages[3] == cut and cut != left
    assert {r.doc_id for r in packed} == set(cut)

"""Nested selection, tasks, recordings and result files: against DuckDB, NumPy and hand-made cases."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tidemark.plans import catalog
from tidemark.plans.portable import STEPS, frame
from tidemark.sources import results

DIR = "/root/testdata/sf0.001"
NAMES = ["inner_scores", "select_best", "nested_predictions", "nested_score", "partition_check", "bag_splits", "task_subjects", "task_epochs", "first_label", "sample_80_20", "weighted_sample", "common_repeats", "paired_wins", "report_rows", "sorted_results", "mean_roc", "crop", "short_recordings", "rebased_marks", "boundary_margin", "unit_scale", "chunks", "latest_checkpoint", "band_powers", "soft_vote"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def say(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [*NAMES, "fold_medians"])
def test_equals_duckdb(spark, con, name):
    got, want = catalog.queries()[name](spark, DIR), con.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    a, b = sorted([say(v) for v in r] for r in got.collect()), sorted([say(r[i]) for i in order] for r in want.fetchall())
    assert len(a) == len(b) and (a == b or all(x == y or abs(float(x) - float(y)) < 2e-6 for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True)))


def softmax(x):
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def dealt(subjects, seed, n):
    out = {}
    for k in range(3):
        own = sorted((s for s, y in subjects.items() if y == k), key=lambda s: (hashlib.md5(f"{s}#{seed}".encode()).hexdigest(), s))
        out |= {s: i % n for i, s in enumerate(own)}
    return out


def auc(y, p):
    a, b = p[y], p[~y]
    return np.mean((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None]))


def by_subject(x, subject, sharp, centroids, who):
    d = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    g = np.log(np.clip(softmax(-sharp * d), 1e-7, 1))
    return {s: softmax(g[subject == s].mean(axis=0)) for s in who}


def test_nested_selection_refits_in_numpy_and_never_sees_the_test_subjects(spark, con):
    rows = con.sql("select label * 8 + vec_id % 8, label, embedding from embeddings where label < 3 order by vec_id").fetchall()
    subject, label, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=float)
    subjects = dict(zip(subject.tolist(), label.tolist(), strict=True))
    sharps = [0.0, 0.05, 0.2, 1.0]
    got = {(r.repeat, r.fold): r for r in catalog.queries()["select_best"](spark, DIR).collect()}
    nested = defaultdict(dict)
    for r in catalog.queries()["nested_predictions"](spark, DIR).collect():
        nested[r.repeat, r.subject][r.k] = r.p
    for repeat in range(10):
        outer = dealt(subjects, 42 + 1000 * repeat, 5)
        for fold in range(5):
            train = {s: y for s, y in subjects.items() if outer[s] != fold}
            inner, scores = dealt(train, 49 + 1000 * repeat, 4), []
            for c, sharp in enumerate(sharps):
                p = {}
                for part in range(4):
                    fit = np.isin(subject, [s for s in train if inner[s] != part])
                    m = np.stack([x[fit & (label == k)].mean(axis=0) for k in range(3)])
                    p |= by_subject(x, subject, sharp, m, [s for s in train if inner[s] == part])
                y, q = np.array([subjects[s] for s in p]), np.round(np.array(list(p.values())), 9)
                bal = np.mean([(q[y == k].argmax(axis=1) == k).mean() for k in range(3)])
                scores.append((-round(bal, 6), -round(np.mean([auc(y == k, q[:, k]) for k in range(3)]), 6), c))
            best = min(scores)
            r = got[repeat, fold]
            assert r.candidate == best[2] and abs(r.balanced_accuracy + best[0]) < 2e-6 and abs(r.macro_auc + best[1]) < 2e-6
            fit = np.isin(subject, list(train))
            m = np.stack([x[fit & (label == k)].mean(axis=0) for k in range(3)])
            for s, p in by_subject(x, subject, sharps[best[2]], m, [s for s in subjects if outer[s] == fold]).items():
                assert np.allclose([nested[repeat, s][k] for k in range(3)], p, atol=2e-6)


def test_labels_of_the_test_fold_do_not_move_the_selection(spark):
    known = {}
    before = {(r.repeat, r.fold): r.candidate for r in frame(spark, DIR, "select_best", known).collect()}
    folds = frame(spark, DIR, "folds", {})
    flipped = known["subject_sums"].join(folds.where("repeat = 0 and fold = 2").select("subject"), "subject", "left_anti")
    again = frame(spark, DIR, "select_best", {"subject_sums": flipped, "folds": folds, "cells3": known["cells3"].join(flipped.select("subject").distinct(), "subject", "left_semi"), "subjects": known["subjects"]})
    assert {(r.repeat, r.fold): r.candidate for r in again.where("repeat = 0 and fold = 2").collect()} == {(0, 2): before[0, 2]}


def test_votes_of_members_that_differ_are_an_error(spark):
    known = {}
    frame(spark, DIR, "soft_vote", known)
    fewer = known["epochs3"].where("label < 2")
    with pytest.raises(Exception, match="differ in their subjects"):
        frame(spark, DIR, "soft_vote", {"subject_proba": known["subject_proba"], "epochs3": fewer}).collect()


def test_a_subject_of_two_labels_is_an_error(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 1, 11)], "subject long, label long, epoch long")
    with pytest.raises(Exception, match="several labels"):
        frame(spark, DIR, "first_label", {"epochs": rows}).collect()


def test_windows_near_a_mark_go(spark):
    n = 100
    rows = [(1, i, "click" if i != 50 else "error", 200.0 if i == 50 else float(i % 7), i) for i in range(n)]
    samples = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double, i long")
    windows = spark.createDataFrame([(1, w) for w in range(11)], "user_id long, epoch long")
    left = {r.epoch for r in frame(spark, DIR, "boundary_margin", {"samples": samples, "windows_sliding": windows}).collect()}
    assert left == {w for w in range(11) if not 8 * w - 4 <= 50 < 8 * w + 16 + 4}
    crop = frame(spark, DIR, "crop", {"samples": samples}).collect()
    assert len(crop) == n - 24 and min(r.i for r in crop) == 0
    assert [r.i for r in frame(spark, DIR, "rebased_marks", {"samples": samples}).collect()] == [34]
    assert frame(spark, DIR, "short_recordings", {"samples": samples}).first().seconds_left == (n - 24) / 8


def test_weighted_sample_is_balanced(spark):
    got = frame(spark, DIR, "weighted_sample").join(frame(spark, DIR, "subjects"), "subject").collect()
    n = Counter(r.label for r in got)
    assert sum(n.values()) == 32 * 24 and max(n.values()) - min(n.values()) <= 1


def test_result_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    run = spark.createDataFrame([(0, 1, "s1", 0, 0.7, 0.3, 4, "{}"), (0, 2, "s2", 1, 0.123456789, 0.876543211, 5, "{}")], "repeat int, fold int, subject string, y int, p_AD double, p_CN double, n_epochs bigint, params string")
    score = spark.createDataFrame([(0, 0.5)], "repeat int, balanced_accuracy double")
    results.write_run(f"{root}/run", run, score, score, score)
    back = results.predictions(spark, f"{root}/run/subject_predictions.csv", ["AD", "CN"])
    assert sorted(tuple(r) for r in back.collect()) == sorted((*r[:4], round(r[4], 5), round(r[5], 5), *r[6:]) for r in run.collect())
    assert results.predictions(spark, f"{root}/none.csv", ["AD"]) is None
    run.write.parquet(f"{root}/m0")
    assert results.epoch_predictions(spark, [f"{root}/m0", f"{root}/m1"]) is None
    assert Counter(r.member for r in results.epoch_predictions(spark, [f"{root}/m0", f"{root}/m0"]).collect()) == {0: 2, 1: 2}
    (tmp_path / "labels.json").write_text('[{"file_name": "a", "label": "A", "type": "train"}, {"file_name": "f", "label": "F", "type": "train"}, {"file_name": "x", "label": "C", "type": "test_cross"}]')
    assert {(r.file_name, r.y) for r in results.chunk_labels(spark, f"{root}/labels.json", "train").collect()} == {("a", 0), ("f", 2)}


def test_comparison_takes_common_repeats_and_refuses_other_subjects(spark):
    a = spark.createDataFrame([(0, "s1", 0, 0.1), (1, "s1", 0, 0.2)], "repeat int, subject string, y int, p_a double")
    b = spark.createDataFrame([(1, "s1", 0, 0.3), (2, "s1", 0, 0.4)], "repeat int, subject string, y int, p_b double")
    assert [(r.repeat, r.subject, r.y) for r in results.require_alike(a, b).collect()] == [(1, "s1", 0)]
    with pytest.raises(Exception, match="subject differs"):
        results.require_alike(a, b.replace("s1", "s9", "subject")).collect()


def test_every_new_step_is_registered():
    assert set(NAMES) <= set(catalog.queries()) and all(n in STEPS for n in NAMES)


def test_report_rounds_ties_to_even_as_its_sql(spark):
    ties = [k / 400 for k in range(401)]  # every other one is a tie, and every other tie goes down
    known = {"mean_sd": spark.createDataFrame([(x, 1 - x) for x in ties], "mean double, sd double"), "bootstrap_ci": spark.createDataFrame([(0.283333, 0.5625)], "lo double, hi double")}
    con = duckdb.connect()
    con.execute("create table mean_sd as select k / 400 as mean, 1 - k / 400 as sd from (select unnest(range(401)) as k)")
    con.execute("create table bootstrap_ci as select 0.283333::double as lo, 0.5625::double as hi")
    s = STEPS["report_rows"]
    want = con.sql((s.duckdb or s.sql).format(mean_sd="mean_sd", bootstrap_ci="bootstrap_ci")).fetchall()
    got = sorted(tuple(r) for r in frame(spark, DIR, "report_rows", known).collect())
    assert got == sorted(want) == sorted(("centroid", f"{100 * x:.1f} ± {100 * (1 - x):.1f} [28.3, 56.2]") for x in ties)


def test_weighted_sample_draws_from_all_subjects_and_epochs(spark):
    """1,000 subjects of one class and 10 of another: each class gets half of the 32 draws a subject, and nearly every subject and epoch is drawn."""
    subjects = spark.range(1010).selectExpr("id as subject", "if(id < 1000, 0, 1) as label")
    epochs = subjects.selectExpr("subject", "label", "explode(sequence(0, 2)) as e").selectExpr("subject", "label", "subject * 3 + e as epoch")
    got = frame(spark, DIR, "weighted_sample", {"subjects": subjects, "epochs3": epochs}).collect()
    assert len(got) == len({r.draw for r in got}) == 32 * 1010 and all(r.epoch // 3 == r.subject for r in got)
    large = Counter(r.subject for r in got if r.subject < 1000)
    assert len(large) == 1000 and abs(sum(large.values()) / len(got) - 0.5) < 0.02 and max(large.values()) < 45
    assert all(abs(n - sum(large.values()) / 3) < 300 for n in Counter(r.epoch % 3 for r in got if r.subject < 1000).values())

"""Ledger rules, migrations and stored tables."""

import pytest
from pyspark.sql import functions as F

from rareclass.operators import ledger as l
from rareclass.operators.features import Recipe
from rareclass.sources import artifacts, prepared, results, tables


def test_matrix_sizes_and_names(spark):
    cells = spark.createDataFrame([(d, m) for d in "xyz" for m in "abcdef"], "dataset string, model string")
    args = (["smote", "no-smote"], ["centralized", "iid", "noniid"])
    assert l.experiment_matrix(cells, *args, [0.5], [42]).count() == 108
    one = l.experiment_matrix(cells.where("dataset = 'x' AND model = 'a'"), ["smote"], args[1], [0.5, 1.0, 5.0], [42])
    assert sorted(r[0] for r in one.select(l.cell_name()).collect()) == [
        "x_smote_centralized_a_ana_s42", "x_smote_iid_a_ana_s42", "x_smote_noniid_a_a0.5_s42", "x_smote_noniid_a_a1_s42", "x_smote_noniid_a_a5_s42"]


def test_fingerprint_is_sensitive(spark):
    df = spark.createDataFrame([("a", "1", None), ("a", "1", None), ("a", "2", None), ("a", "1", "")], "run string, data string, part string")
    h = [r[0] for r in df.select(l.fingerprint(["run", "data", "part"])).collect()]
    assert h[0] == h[1] and len(set(h)) == 3


def test_migration_counts_rounds_and_is_idempotent(spark):
    old = spark.createDataFrame([("d", "a", "lr", "iid", "0.5", "21", "20"), ("d", "b", "gbm", "iid", "", "15", ""), ("d", "c", "big", "iid", "", "38", ""),
                                 ("d", "e", "lr", "centralized", "", "n/a", "n/a"), ("d", "f", "lr", "iid", "", "21", "")],
                                "dataset string, run_name string, model string, scheme string, alpha string, rounds_completed string, num_rounds string")
    rounds = spark.createDataFrame([("d", n, str(i)) for n, ids in (("a", range(21)), ("b", range(1, 16)), ("c", range(38))) for i in ids],
                                   "dataset string, run_name string, round string")
    new = l.migrate_summary(old, rounds, {"big": 50})
    got = {r["run_name"]: (r["rounds_completed"], r["rounds_configured"]) for r in new.collect()}
    assert got == {"a": ("20", "20"), "b": ("15", "20"), "c": ("37", "50"), "e": ("n/a", "n/a"), "f": ("20", "20")}
    assert new.columns == list(l.SUMMARY_COLUMNS) and l.migrate_summary(new, rounds) is new
    assert l.drop_initial_round(rounds).where("round = '0'").count() == 0
    assert l.drop_initial_round(l.drop_initial_round(rounds)).count() == rounds.count() - 2


def test_raw_features(spark, tmp_path):
    header = ",".join(c for c, _ in tables.PAYSIM_COLUMNS)
    body = ["1,TRANSFER,10.5,C1,100,80,M1,0,10.5,0,0", "1,ODD,10.5,C1,100,80,M1,0,10.5,1,0"] + ["2,DEBIT,1,C2,5,4,M2,0,1,0,0"] * 5
    (tmp_path / "p.csv").write_text("\n".join([header, *body]) + "\n")
    raw = tables.with_row_id(tables.read_raw(spark, "paysim", str(tmp_path)), chunk=2)
    assert raw.count() == 7 and raw.select("row_id").distinct().count() == 7
    f = tables.raw_features(raw, "paysim")
    names = [c for c in f.columns if c not in ("row_id", "label")]
    assert len(names) == 13 and {t for c, t in f.dtypes if c in names} == {"float"}
    odd = f.where("label = 1").first()
    assert sum(odd[c] for c in names if c.startswith("type_")) == 0 and odd["errorBalanceOrig"] == -9.5
    with pytest.raises(ValueError):
        tables.dataset("other")
    assert len([c for c, _ in tables.BAF_COLUMNS]) == 32


def test_store_reuses_and_refuses_changed_types(spark, tmp_path):
    df = spark.createDataFrame([(i, int(i % 9 == 0), float(i if i % 5 else -1), 3.0) for i in range(200)], "row_id bigint, y int, a double, one double")
    recipe = Recipe(label="y", sentinels=("a",))
    calls = []
    build = lambda: calls.append(1) or prepared.prepare(df, recipe)
    config = {"seed": 42}
    first, h1 = prepared.stored_split(spark, str(tmp_path), config, build)
    again, h2 = prepared.stored_split(spark, str(tmp_path), config, build)
    assert h1 == h2 and len(calls) == 1 and again.count() == 200
    assert dict(again.dtypes)["a"] == "float" and dict(again.dtypes)["label"] == "int"
    assert again.where("a IS NULL").count() == 0 and again.where("one <> 0").count() == 0  # constant column is centred only
    path = f"{tmp_path}/prepared/{prepared.config_key(config)}/data"
    spark.read.parquet(path).where("row_id < 5").withColumn("a", F.col("a").cast("double")).write.mode("overwrite").partitionBy("split").parquet(path + "2")
    import shutil
    shutil.rmtree(path)
    shutil.move(path + "2", path)
    with pytest.raises(TypeError):
        prepared.stored_split(spark, str(tmp_path), config, build)
    with pytest.raises(ValueError):
        prepared.stored_assignment(spark, str(tmp_path), {"condition": "centralized"}, build)
    assert prepared.config_key({"a": 1, "b": 2}) == prepared.config_key({"b": 2, "a": 1}) != prepared.config_key({"a": 1, "b": 3})


def test_scan_reads_every_layout(spark, tmp_path):
    (tmp_path / "d" / "lr").mkdir(parents=True)
    (tmp_path / "d" / "lr" / "a.csv").write_text("dataset,run_name,x\nd,a,1\n")
    (tmp_path / "d" / "b.csv").write_text('run_name,dataset,y\nb,d,"4,5"\n')
    (tmp_path / "d" / "lr" / "a_rounds.csv").write_text("round\n1\n")
    got = {r["run_name"]: (r["dataset"], r["x"], r["y"]) for r in results.scan_ledger(spark, str(tmp_path)).collect()}
    assert got == {"a": ("d", "1", None), "b": ("d", None, "4,5")}


def test_run_names_are_parsed_in_order(spark):
    names = ["lr_dirichlet_alpha0.5_smote_seed1", "lr_big_iid_alpha-_none_seed1", "centralized_lr_none_seed1", "who_iid_none"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(*artifacts.run_parts("n", ["lr_big", "lr"]))
    assert [tuple(r) for r in df.collect()] == [("lr", "dirichlet", "smote", 0.5), ("lr_big", "iid", "none", None),
                                                ("lr", "centralized", "none", None), (None, "iid", "none", None)]


def test_grouped_summary_never_joins_the_history(spark):
    """A history unfolded from one small row per run looks small to Spark, which would broadcast all its rounds through the driver."""
    runs = spark.createDataFrame([("d", "a", "5"), ("d", "b", "5")], "dataset string, run_name string, rounds_configured string")
    rounds = runs.select("dataset", "run_name", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("round"))
    r = F.col("round")
    history = rounds.select("dataset", "run_name", "round", (r * 3 % 4 / 10).alias("val_auprc"), F.lit(None).cast("double").alias("test_auprc"),
                            (r / 10).alias("val_f1"), (r / 20).alias("val_precision"), (r / 40).alias("val_recall"), (r / 80).alias("val_recall_at_fpr"))
    df = results.grouped_summary(runs, history)
    got = {x["run_name"]: (x["best_round"], x["best_val_auprc"], x["best_val_f1"], x["rounds_completed"]) for x in df.collect()}
    assert got == {"a": (1, 0.3, 0.1, 3), "b": (1, 0.3, 0.1, 3)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2

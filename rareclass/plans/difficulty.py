"""The difficulty summary of one dataset: all features against the best few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareclass.operators import separability as g
from rareclass.operators.features import top_features
from rareclass.operators.splits import balanced_subsample
from rareclass.session import cut_lineage, written

MATCHED_WIDTH = 13


def difficulty_summary(df: DataFrame, dataset: str, cap: int | None = None, width: int = MATCHED_WIDTH) -> DataFrame:
    """Typology and overlap on all rows, N1-N3 and F1 on the balanced table (all positives, as many
    negatives; ``cap`` bounds both only when it is given), repeated with the ``width`` best features, and the differences. Each measure is one number, gathered into one row.

    What several measures read is made once: the balanced table, and the AUC of every feature.
    """
    balanced = cut_lineage(balanced_subsample(df, cap))
    univariate = written(g.univariate_auc_ks(g.long_features(df)), "difficulty-features")
    best = [int(n[1:]) for n in top_features(univariate, width)]
    pick = F.array(*[F.get("features", F.lit(i)) for i in sorted(best)])
    few, few_balanced = (d.withColumn("features", pick) for d in (df, balanced))
    row = {
        "dataset": dataset,
        "rare_outlier_pct": g.minority_typology(df).first()["rare_outlier_pct"],
        "n1": g.n1_boundary(balanced).first()["n1"], "n2": g.n2_ratio(balanced).first()["n2"],
        "n3": g.n3_error(balanced).first()["n3"], "f1": g.fisher_inverse(g.long_features(balanced)).first()["f1"],
        "lda_overlap": g.overlap_coefficient(g.lda_projection(df)).first()["overlap"],
        "max_auc": univariate.agg(F.max("auc")).first()[0],
        "rare_outlier_pct_matched": g.minority_typology(few).first()["rare_outlier_pct"],
        "n3_matched": g.n3_error(few_balanced).first()["n3"],
    }
    row["rare_outlier_delta"] = row["rare_outlier_pct_matched"] - row["rare_outlier_pct"]
    row["n3_delta"] = row["n3_matched"] - row["n3"]
    return df.sparkSession.range(1).select(*[F.lit(v).cast("string" if k == "dataset" else "double").alias(k) for k, v in row.items()])

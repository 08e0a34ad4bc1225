"""Data checks (Q1): table constraints as one aggregate per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ROLES


def _unpivot(df: DataFrame, tbl: str, names: list[str]) -> DataFrame:
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("bigint"))]
    return df.select(F.lit(tbl).alias("tbl"), F.stack(F.lit(len(names)), *pairs).alias("rule", "violations"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first per key (partial count per key, then sum)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")) \
             .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("id_unique"))


def constraint_report(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Q1 for the profile table: NOT NULL name/role/flag, role in the list,
    primary key unique and not null, foreign key to users."""
    checks = profiles.agg(
        F.count_if(F.col("id").isNull()).alias("id_not_null"),
        F.count_if(F.col("nome").isNull()).alias("nome_not_null"),
        F.count_if(F.col("papel").isNull()).alias("papel_not_null"),
        F.count_if(~F.coalesce(F.col("papel").isin(*ROLES), F.lit(True))).alias("papel_in_list"),
        F.count_if(F.col("senha_provisoria").isNull()).alias("senha_not_null"))
    dup = duplicate_keys(profiles, "id")
    orphans = profiles.join(users.select("id"), "id", "left_anti").agg(
        F.count(F.lit(1)).cast("bigint").alias("id_in_users"))
    names = ["id_not_null", "nome_not_null", "papel_not_null", "papel_in_list", "senha_not_null"]
    return _unpivot(checks, "perfil", names).unionByName(_unpivot(dup, "perfil", ["id_unique"])) \
        .unionByName(_unpivot(orphans, "perfil", ["id_in_users"]))


def document_constraints(df: DataFrame, tbl: str, key: str) -> DataFrame:
    """Q1 for the document and history tables: key and document not null, a
    version of 1 or more, key unique."""
    checks = df.agg(
        F.count_if(F.col(key).isNull()).alias("id_not_null"),
        F.count_if(F.col("doc").isNull()).alias("dados_not_null"),
        F.count_if(F.col("version").isNull()).alias("versao_not_null"),
        F.count_if(F.col("version") < 1).alias("versao_positive"))
    return _unpivot(checks, tbl, ["id_not_null", "dados_not_null", "versao_not_null", "versao_positive"]).unionByName(
        _unpivot(duplicate_keys(df, key), tbl, ["id_unique"]))

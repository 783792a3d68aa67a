"""Role tags on rows, role filters before ranking, and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.text import col

# The roles, and keywords that restrict a text to some of them, in order of precedence.
ROLES = ("Admin", "HR", "Risk_Manager", "Staff", "Guest")
HR_WORDS = ("bảo hiểm", "nhân sự", "lương", "thưởng", "tuyển dụng", "bổ nhiệm", "lao động", "tập sự", "kỷ luật", "người lao động")
RISK_WORDS = ("tín dụng", "rủi ro", "hạn mức", "phê duyệt", "cho vay", "tài sản bảo đảm", "tỷ lệ an toàn vốn", "ngoại hối", "quản lý dự trữ", "đầu tư gián tiếp", "thẩm định")
HR_ROLES, RISK_ROLES = ("Admin", "HR"), ("Admin", "Risk_Manager", "Staff")


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def allowed_roles(title: str | Column, text: str | Column) -> Column:
    """Roles that may see a row, by the first class of keywords that its title or text holds."""
    both = F.lower(F.concat(F.coalesce(col(title), F.lit("")), F.lit(" "), F.coalesce(col(text), F.lit(""))))
    roles = lambda names: F.array(*[F.lit(x) for x in names])
    return F.when(_any_word(both, HR_WORDS), roles(HR_ROLES)).when(_any_word(both, RISK_WORDS), roles(RISK_ROLES)).otherwise(roles(ROLES))


def parse_roles(c: str | Column) -> Column:
    """Roles of a JSON list; malformed or empty text gives no role, so the row is seen by nobody."""
    return F.coalesce(F.from_json(col(c), T.ArrayType(T.StringType()), {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def may_see(roles: str | Column, user: list[str]) -> Column:
    """Whether any of the user's roles is allowed; no roles, no rows."""
    if not user:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(col(roles), F.array(*[F.lit(r) for r in user])), F.lit(False))


def pattern_counts(tagged: DataFrame, roles: str = "roles") -> DataFrame:
    """Role patterns with their number and share of rows."""
    n = tagged.groupBy(F.array_join(roles, ",").alias("pattern")).agg(F.count("*").alias("n"))
    total = tagged.agg(F.count("*").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("pattern", "n", F.round(F.col("n") * 100 / F.col("total"), 4).alias("percent"))


def role_coverage(tagged: DataFrame, roles: str = "roles") -> DataFrame:
    """Rows each role may see, with their share."""
    n = tagged.select(F.explode(roles).alias("role")).groupBy("role").agg(F.count("*").alias("n"))
    total = tagged.agg(F.count("*").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("role", "n", F.round(F.col("n") * 100 / F.col("total"), 4).alias("percent"))


def group_roles(tagged: DataFrame, key: str, roles: str = "roles") -> DataFrame:
    """Union of the roles of a group's rows, in alphabetical order."""
    return tagged.select(key, F.explode(roles).alias("role")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def tag_audit(tagged: DataFrame, key: str, roles: str = "roles") -> DataFrame:
    """Per role pattern: rows, and its first row by key as a sample; rows without any role stand under an empty pattern."""
    return tagged.groupBy(F.array_join(F.coalesce(F.col(roles), F.array().cast("array<string>")), ",").alias("pattern")).agg(F.count("*").alias("n"), F.min(key).alias("sample"))


def leakage(cases: DataFrame, unauthorised: DataFrame, authorised: DataFrame) -> DataFrame:
    """Per case: how many rows either side got, leaked (the target is among what unauthorised roles got), found (among what authorised
    ones got), passed (found and not leaked).

    `cases` has query_id, target and by_chunk; the results have query_id, id and document, all as text.  A target
    is a chunk's id where by_chunk holds, else a document's, of which any chunk counts."""

    def side(df: DataFrame, name: str, count: str) -> DataFrame:
        met = cases.select("query_id", "target", "by_chunk").join(df, "query_id")
        is_it = F.when(F.col("by_chunk"), F.col("id") == F.col("target")).otherwise(F.col("document") == F.col("target"))
        return met.groupBy("query_id").agg(F.max(F.coalesce(is_it, F.lit(False))).alias(name), F.count("*").alias(count))

    rows = cases.join(side(unauthorised, "leaked", "n_unauthorised"), "query_id", "left").join(side(authorised, "found", "n_authorised"), "query_id", "left")
    rows = rows.fillna(False, ["leaked", "found"]).fillna(0, ["n_unauthorised", "n_authorised"])
    return rows.select("query_id", "target", "n_unauthorised", "n_authorised", "leaked", "found", (~F.col("leaked") & F.col("found")).alias("passed"))

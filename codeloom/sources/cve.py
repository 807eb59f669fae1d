"""Vulnerability feeds (NVD JSON 1.1)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.schemas import CVE_FEED


def read_cve_feeds(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Yearly feeds, one row per feed file."""
    return spark.read.option("multiLine", True).schema(CVE_FEED).json(paths)


def feed_paths(root: str, years: Iterable[int]) -> list[str]:
    return [f"{root}/nvdcve-1.1-{year}.json" for year in years]


_V2, _V3 = "impact.baseMetricV2", "impact.baseMetricV3"
# The output columns in order, each with the feed field it shows.
CVE_FIELDS = {
    "cve_id": "cve.CVE_data_meta.ID",
    "published_date": "publishedDate",
    "last_modified_date": "lastModifiedDate",
    "description": "cve.description.description_data",
    "nodes": "configurations.nodes",
    "severity": f"{_V2}.severity",
    "obtain_all_privilege": f"{_V2}.obtainAllPrivilege",
    "obtain_user_privilege": f"{_V2}.obtainUserPrivilege",
    "obtain_other_privilege": f"{_V2}.obtainOtherPrivilege",
    "user_interaction_required": f"{_V2}.userInteractionRequired",
    "cvss2_vector_string": f"{_V2}.cvssV2.vectorString",
    "cvss2_access_vector": f"{_V2}.cvssV2.accessVector",
    "cvss2_access_complexity": f"{_V2}.cvssV2.accessComplexity",
    "cvss2_authentication": f"{_V2}.cvssV2.authentication",
    "cvss2_confidentiality_impact": f"{_V2}.cvssV2.confidentialityImpact",
    "cvss2_integrity_impact": f"{_V2}.cvssV2.integrityImpact",
    "cvss2_availability_impact": f"{_V2}.cvssV2.availabilityImpact",
    "cvss2_base_score": f"{_V2}.cvssV2.baseScore",
    "cvss3_vector_string": f"{_V3}.cvssV3.vectorString",
    "cvss3_attack_vector": f"{_V3}.cvssV3.attackVector",
    "cvss3_attack_complexity": f"{_V3}.cvssV3.attackComplexity",
    "cvss3_privileges_required": f"{_V3}.cvssV3.privilegesRequired",
    "cvss3_user_interaction": f"{_V3}.cvssV3.userInteraction",
    "cvss3_scope": f"{_V3}.cvssV3.scope",
    "cvss3_confidentiality_impact": f"{_V3}.cvssV3.confidentialityImpact",
    "cvss3_integrity_impact": f"{_V3}.cvssV3.integrityImpact",
    "cvss3_availability_impact": f"{_V3}.cvssV3.availabilityImpact",
    "cvss3_base_score": f"{_V3}.cvssV3.baseScore",
    "cvss3_base_severity": f"{_V3}.cvssV3.baseSeverity",
    "exploitability_score": f"{_V3}.exploitabilityScore",
    "impact_score": f"{_V3}.impactScore",
    "ac_insuf_info": f"{_V2}.acInsufInfo",
    "reference_json": "cve.references.reference_data",
    "problemtype_json": "cve.problemtype.problemtype_data",
}


def flatten_cve(feeds: DataFrame, keep_unreferenced: bool = True) -> DataFrame:
    """One flat row per record; records with an empty reference list go.

    A missing reference list counts as kept unless ``keep_unreferenced`` is off.
    """
    refs = F.size("item.cve.references.reference_data")  # null for a missing list
    missing = F.col("item.cve.references.reference_data").isNull()
    keep = (missing & F.lit(keep_unreferenced)) | (~missing & (refs > 0))
    return (
        feeds.select(F.explode("CVE_Items").alias("item")).filter(keep)
        .select(*[F.col(f"item.{field}").alias(name) for name, field in CVE_FIELDS.items()])
    )


def as_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def cast_all_string(df: DataFrame) -> DataFrame:
    """Every column as text; nested values as JSON."""
    return df.select(*[as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])

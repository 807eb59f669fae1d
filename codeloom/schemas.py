"""Table schemas."""

from pyspark.sql import types as T


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# The column order of the statement table.
FINDING_COLUMNS = [
    "file", "line", "column", "defaultlevel", "level", "category", "name", "msg", "note",
    "cwe", "context", "helpuri", "severity", "tool", "type",
]
FINDING = _strings(FINDING_COLUMNS)
STATEMENT = _strings(FINDING_COLUMNS + ["project"])
FUNCTION = _strings(["file", "code", "context", "cwe", "project"])
PROJECT = T.StructType([
    T.StructField("project_id", T.LongType()),
    T.StructField("project", T.StringType()),
    T.StructField("status", T.StringType()),
])

# Report columns that never reach the statement table.
REPORT_ONLY_COLUMNS = ["toolversion", "fingerprint", "ruleid", "suggestion", "inconclusive"]

MISSING = "-"
BENIGN = "Benign"
UNKNOWN_CWE = "CWE-unknown"

FLAWFINDER_CSV = _strings([
    "File", "Line", "Column", "DefaultLevel", "Level", "Category", "Name", "Warning",
    "Suggestion", "Note", "CWEs", "Context", "Fingerprint", "ToolVersion", "RuleId", "HelpUri",
])

CPPCHECK_ERROR = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("_severity", T.StringType()),
    T.StructField("_msg", T.StringType()),
    T.StructField("_verbose", T.StringType()),
    T.StructField("_cwe", T.StringType()),
    T.StructField("_file0", T.StringType()),
    T.StructField("_inconclusive", T.StringType()),
    T.StructField("location", T.ArrayType(T.StructType([
        T.StructField("_file", T.StringType()),
        T.StructField("_line", T.StringType()),
        T.StructField("_column", T.StringType()),
        T.StructField("_info", T.StringType()),
    ]))),
])

RATS_VULNERABILITY = T.StructType([
    T.StructField("severity", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("file", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("line", T.ArrayType(T.StringType())),
    ]))),
])


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _D, _B = T.StringType(), T.DoubleType(), T.BooleanType()
_LANG_VALUES = T.ArrayType(_struct(lang=_S, value=_S))

CVE_ITEM = _struct(
    cve=_struct(
        data_type=_S, data_format=_S, data_version=_S,
        CVE_data_meta=_struct(ID=_S, ASSIGNER=_S),
        problemtype=_struct(problemtype_data=T.ArrayType(_struct(description=_LANG_VALUES))),
        references=_struct(reference_data=T.ArrayType(
            _struct(url=_S, name=_S, refsource=_S, tags=T.ArrayType(_S)))),
        description=_struct(description_data=_LANG_VALUES),
    ),
    # Configuration nodes nest without limit, so they stay raw JSON text.
    configurations=_struct(CVE_data_version=_S, nodes=_S),
    impact=_struct(
        baseMetricV2=_struct(
            cvssV2=_struct(
                version=_S, vectorString=_S, accessVector=_S, accessComplexity=_S,
                authentication=_S, confidentialityImpact=_S, integrityImpact=_S,
                availabilityImpact=_S, baseScore=_D),
            severity=_S, exploitabilityScore=_D, impactScore=_D, acInsufInfo=_B,
            obtainAllPrivilege=_B, obtainUserPrivilege=_B, obtainOtherPrivilege=_B,
            userInteractionRequired=_B),
        baseMetricV3=_struct(
            cvssV3=_struct(
                version=_S, vectorString=_S, attackVector=_S, attackComplexity=_S,
                privilegesRequired=_S, userInteraction=_S, scope=_S, confidentialityImpact=_S,
                integrityImpact=_S, availabilityImpact=_S, baseScore=_D, baseSeverity=_S),
            exploitabilityScore=_D, impactScore=_D),
    ),
    publishedDate=_S, lastModifiedDate=_S,
)
CVE_FEED = _struct(
    CVE_data_type=_S, CVE_data_format=_S, CVE_data_version=_S, CVE_data_numberOfCVEs=_S,
    CVE_data_timestamp=_S, CVE_Items=T.ArrayType(CVE_ITEM),
)

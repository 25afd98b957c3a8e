"""Pattern, solution, focus-area and recommendation catalogs.

A catalog is plain data: an ordered list of :class:`Category`. Operators turn
it into literal-pattern column expressions; :func:`catalog_df` gives the same
data as a small DataFrame for joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SEVERITY_WEIGHT = {"critical": 5.0, "high": 3.0, "medium": 2.0, "low": 1.0}


@dataclass(frozen=True)
class Category:
    """One error category: its patterns and how much it matters."""

    name: str
    patterns: tuple[str, ...]
    severity: str = "low"
    label: str = ""
    priority: int = 50

    @property
    def weight(self) -> float:
        """What one match of this category adds to a chunk's score."""
        return SEVERITY_WEIGHT.get(self.severity, 0.5) * self.priority / 100.0


Catalog = Sequence[Category]

# --------------------------------------------------------------------------
# Analysis catalog, highest priority first.
# --------------------------------------------------------------------------
ANALYSIS_CATALOG: Catalog = (
    Category("memory_errors", (
        r"(?i)outofmemoryerror",
        r"(?i)java\.lang\.outofmemoryerror",
        r"(?i)container\s+killed.*memory",
        r"(?i)executor\s+lost.*outofmemory",
        r"(?i)gc\s+overhead\s+limit\s+exceeded",
        r"(?i)unable\s+to\s+allocate\s+.*\s+bytes",
        r"(?i)heap\s+space\s+exhausted",
        r"(?i)metaspace\s+out\s+of\s+memory",
        r"(?i)direct\s+buffer\s+memory\s+exceeded",
        r"(?i)oom\s+killer",
        r"(?i)memory\s+allocation\s+failed",
    ), "critical", "Memory Management", 100),
    Category("spark_sql_errors", (
        r"(?i)analysisexception",
        r"(?i)org\.apache\.spark\.sql\.analysisexception",
        r"(?i)table\s+or\s+view\s+not\s+found",
        r"(?i)cannot\s+resolve.*given\s+input\s+columns",
        r"(?i)column\s+.*\s+does\s+not\s+exist",
        r"(?i)path\s+does\s+not\s+exist",
        r"(?i)schema\s+mismatch",
        r"(?i)invalid\s+column\s+reference",
        r"(?i)ambiguous\s+reference\s+to\s+fields",
        r"(?i)unresolved\s+attribute",
        r"(?i)unsupported\s+data\s+type",
    ), "high", "SQL Analysis", 90),
    Category("spark_execution_errors", (
        r"(?i)sparkexception",
        r"(?i)org\.apache\.spark\.sparkexception",
        r"(?i)job\s+\d+\s+failed",
        r"(?i)stage\s+\d+\s+failed",
        r"(?i)task\s+failed",
        r"(?i)executor\s+\d+\s+lost",
        r"(?i)driver\s+stacktrace",
        r"(?i)application\s+failed",
        r"(?i)shuffle\s+fetch\s+failed",
        r"(?i)broadcast\s+failed",
        r"(?i)rdd\s+operation\s+failed",
    ), "high", "Spark Execution", 85),
    Category("application_errors", (
        r"(?i)\b(?:exception|error|failure|fatal)\b.*\n?.*\bat\s+[a-zA-Z0-9_.$]+\.[a-zA-Z0-9_$]+\(",
        r"(?i)\bexception\s+in\s+thread\b",
        r"(?i)caused\s+by:.*exception",
        r"(?i)\berror\s*:\s*\w+",
        r"(?i)\bfatal\s+error\b",
        r"(?i)\bcritical\s+error\b",
        r"(?i)\bsevere\s+error\b",
        r"(?i)\bunhandled\s+exception\b",
        r"(?i)\bstack\s+overflow\b",
        r"(?i)\bsegmentation\s+fault\b",
        r"(?i)\bcore\s+dumped\b",
    ), "high", "Application Runtime", 80),
    Category("io_errors", (
        r"(?i)filenotfoundexception",
        r"(?i)ioexception",
        r"(?i)no\s+such\s+file\s+or\s+directory",
        r"(?i)permission\s+denied",
        r"(?i)access\s+denied",
        r"(?i)disk\s+space\s+exhausted",
        r"(?i)no\s+space\s+left\s+on\s+device",
        r"(?i)read\s+timed\s+out",
        r"(?i)write\s+failed",
        r"(?i)cannot\s+open\s+file",
        r"(?i)file\s+is\s+corrupted",
        r"(?i)bad\s+file\s+descriptor",
        r"(?i)resource\s+temporarily\s+unavailable",
    ), "high", "File I/O", 75),
    Category("network_errors", (
        r"(?i)connection\s+refused",
        r"(?i)connection\s+timeout",
        r"(?i)connection\s+reset",
        r"(?i)unknownhostexception",
        r"(?i)sockettimeoutexception",
        r"(?i)network\s+is\s+unreachable",
        r"(?i)host\s+is\s+unreachable",
        r"(?i)broken\s+pipe",
        r"(?i)connection\s+aborted",
        r"(?i)ssl\s+handshake\s+failed",
        r"(?i)certificate\s+error",
        r"(?i)dns\s+resolution\s+failed",
    ), "medium", "Network", 70),
    Category("serialization_errors", (
        r"(?i)serializationexception",
        r"(?i)notserializableexception",
        r"(?i)task\s+not\s+serializable",
        r"(?i)classnotfoundexception",
        r"(?i)classcastexception",
        r"(?i)nosuchmethodexception",
        r"(?i)incompatible\s+types",
        r"(?i)type\s+mismatch",
        r"(?i)serialization\s+failed",
        r"(?i)deserialization\s+failed",
    ), "high", "Serialization", 65),
    Category("config_errors", (
        r"(?i)configuration\s+error",
        r"(?i)invalid\s+configuration",
        r"(?i)missing\s+configuration",
        r"(?i)property\s+not\s+found",
        r"(?i)environment\s+variable\s+not\s+set",
        r"(?i)classpath\s+error",
        r"(?i)library\s+not\s+found",
        r"(?i)dependency\s+conflict",
        r"(?i)version\s+mismatch",
        r"(?i)unsupported\s+version",
    ), "medium", "Configuration", 60),
    Category("auth_errors", (
        r"(?i)authentication\s+failed",
        r"(?i)authorization\s+failed",
        r"(?i)access\s+token\s+expired",
        r"(?i)invalid\s+credentials",
        r"(?i)permission\s+denied",
        r"(?i)unauthorized\s+access",
        r"(?i)forbidden\s+access",
        r"(?i)ssl\s+certificate\s+error",
        r"(?i)kerberos\s+authentication\s+failed",
        r"(?i)security\s+exception",
    ), "high", "Authentication & Security", 55),
    Category("database_errors", (
        r"(?i)sql\s+exception",
        r"(?i)database\s+connection\s+failed",
        r"(?i)table\s+does\s+not\s+exist",
        r"(?i)duplicate\s+key\s+value",
        r"(?i)constraint\s+violation",
        r"(?i)deadlock\s+detected",
        r"(?i)lock\s+timeout",
        r"(?i)transaction\s+failed",
        r"(?i)rollback\s+failed",
        r"(?i)connection\s+pool\s+exhausted",
    ), "high", "Database", 50),
    Category("performance_issues", (
        r"(?i)performance\s+degradation",
        r"(?i)slow\s+query",
        r"(?i)timeout\s+exceeded",
        r"(?i)resource\s+exhausted",
        r"(?i)thread\s+pool\s+exhausted",
        r"(?i)cpu\s+usage\s+high",
        r"(?i)gc\s+pressure",
        r"(?i)long\s+running\s+task",
        r"(?i)bottleneck\s+detected",
        r"(?i)queue\s+full",
    ), "medium", "Performance", 45),
    Category("critical_keywords", (
        r"(?i)\bfailed\b.*\berror\b",
        r"(?i)\berror\b.*\bfailed\b",
        r"(?i)\bfatal\b.*\b(?:error|exception|failure)\b",
        r"(?i)\bcritical\b.*\b(?:error|exception|failure)\b",
        r"(?i)\bsevere\b.*\b(?:error|exception|failure)\b",
        r"(?i)\baborted\b.*\b(?:error|exception|failure)\b",
        r"(?i)\bpanic\b.*\b(?:error|exception|failure)\b",
        r"(?i)\bcrash\b.*\b(?:error|exception|failure)\b",
    ), "medium", "Critical Keywords", 40),
)

# --------------------------------------------------------------------------
# Search catalog.
# --------------------------------------------------------------------------
SEARCH_CATALOG: Catalog = (
    Category("critical_errors", (
        r"(?i)\bfatal\s+error\b",
        r"(?i)\bcritical\s+error\b",
        r"(?i)\boutofmemoryerror\b",
        r"(?i)\bsegmentation\s+fault\b",
        r"(?i)\bcore\s+dumped\b",
        r"(?i)\bpanic\b.*\berror\b",
        r"(?i)\bcrash\b.*\berror\b",
    )),
    Category("spark_errors", (
        r"(?i)\banalysisexception\b",
        r"(?i)\bsparkexception\b",
        r"(?i)org\.apache\.spark\..*exception",
        r"(?i)\bjob\s+\d+\s+failed\b",
        r"(?i)\bstage\s+\d+\s+failed\b",
        r"(?i)\btask\s+failed\b",
        r"(?i)\bexecutor\s+lost\b",
        r"(?i)\bdriver\s+stacktrace\b",
        r"(?i)\bshuffle\s+fetch\s+failed\b",
    )),
    Category("memory_issues", (
        r"(?i)\boutofmemoryerror\b",
        r"(?i)java\.lang\.outofmemoryerror",
        r"(?i)\bcontainer\s+killed.*memory\b",
        r"(?i)\bgc\s+overhead\s+limit\b",
        r"(?i)\bheap\s+space\s+exhausted\b",
        r"(?i)\bmetaspace\s+out\s+of\s+memory\b",
        r"(?i)\bdirect\s+buffer\s+memory\b",
    )),
    Category("io_errors", (
        r"(?i)\bfilenotfoundexception\b",
        r"(?i)\bioexception\b",
        r"(?i)\bno\s+such\s+file\s+or\s+directory\b",
        r"(?i)\bpermission\s+denied\b",
        r"(?i)\baccess\s+denied\b",
        r"(?i)\bdisk\s+space\s+exhausted\b",
        r"(?i)\bno\s+space\s+left\s+on\s+device\b",
        r"(?i)\bread\s+timed\s+out\b",
    )),
    Category("network_errors", (
        r"(?i)\bconnection\s+refused\b",
        r"(?i)\bconnection\s+timeout\b",
        r"(?i)\bconnection\s+reset\b",
        r"(?i)\bunknownhostexception\b",
        r"(?i)\bsockettimeoutexception\b",
        r"(?i)\bnetwork\s+is\s+unreachable\b",
        r"(?i)\bhost\s+is\s+unreachable\b",
        r"(?i)\bbroken\s+pipe\b",
    )),
    Category("application_errors", (
        r"(?i)\bnullpointerexception\b",
        r"(?i)\bclassnotfoundexception\b",
        r"(?i)\bclasscastexception\b",
        r"(?i)\bnumberformatexception\b",
        r"(?i)\billegalargumentexception\b",
        r"(?i)\billegalstateexception\b",
        r"(?i)\bunsupportedoperationexception\b",
        r"(?i)\bruntimeexception\b",
    )),
    Category("authentication_errors", (
        r"(?i)\bauthentication\s+failed\b",
        r"(?i)\bauthorization\s+failed\b",
        r"(?i)\baccess\s+token\s+expired\b",
        r"(?i)\binvalid\s+credentials\b",
        r"(?i)\bunauthorized\s+access\b",
        r"(?i)\bforbidden\s+access\b",
        r"(?i)\bssl\s+certificate\s+error\b",
    )),
    Category("configuration_errors", (
        r"(?i)\bconfiguration\s+error\b",
        r"(?i)\binvalid\s+configuration\b",
        r"(?i)\bmissing\s+configuration\b",
        r"(?i)\bproperty\s+not\s+found\b",
        r"(?i)\benvironment\s+variable\s+not\s+set\b",
        r"(?i)\bclasspath\s+error\b",
        r"(?i)\blibrary\s+not\s+found\b",
    )),
)

# --------------------------------------------------------------------------
# Search levels (level 3 is the whole search catalog) and the
# quick-scan catalog.
# --------------------------------------------------------------------------
LEVEL_CATALOGS: tuple[Catalog, ...] = (
    (
        Category("critical_errors", (
            r"(?i)\bfatal\s+error\b",
            r"(?i)\boutofmemoryerror\b",
            r"(?i)\bsegmentation\s+fault\b",
        )),
    ),
    (
        Category("spark_errors", (
            r"(?i)\banalysisexception\b",
            r"(?i)\bjob\s+\d+\s+failed\b",
            r"(?i)\btask\s+failed\b",
        )),
        Category("memory_issues", (
            r"(?i)\boutofmemoryerror\b",
            r"(?i)\bcontainer\s+killed.*memory\b",
        )),
    ),
    SEARCH_CATALOG,
)
LEVEL_CAPS = (20, 50, 50)

QUICK_CATALOG: Catalog = (
    Category("critical_errors", (
        r"(?i)\bfatal\s+error\b",
        r"(?i)\boutofmemoryerror\b",
        r"(?i)\bjob\s+\d+\s+failed\b",
        r"(?i)\banalysisexception\b",
    )),
)

# Whole-word keywords of the chunk score and their weights.
SCORE_KEYWORDS = (
    ("fatal", 2.0),
    ("critical", 2.0),
    ("severe", 1.8),
    ("error", 1.5),
    ("exception", 1.5),
    ("failed", 1.2),
    ("failure", 1.2),
    ("warning", 0.8),
    ("warn", 0.8),
)

# Score by log type; types not listed count as unknown.
LOG_TYPE_WEIGHT = {
    "stderr": 1.0,
    "log4j": 0.8,
    "driver": 0.9,
    "executor": 0.7,
    "stdout": 0.3,
    "unknown": 0.1,
}

# File orders of pattern search and of chunk analysis.
SEARCH_FILE_ORDER = ("stderr", "log4j", "driver", "executor", "stdout", "unknown")
ANALYSIS_FILE_ORDER = ("stderr", "log4j", "driver", "executor")

# Focus area -> search categories.
FOCUS_AREAS = {
    "memory": ("memory_issues", "critical_errors"),
    "spark": ("spark_errors",),
    "io": ("io_errors",),
    "network": ("network_errors",),
    "auth": ("authentication_errors",),
    "config": ("configuration_errors",),
    "app": ("application_errors",),
}

# Advice shown when a search category has at least one match.
RECOMMENDATIONS = (
    ("memory_issues", "Memory ran out: find the stage with the largest tasks, split its input further, then size the heap"),
    ("spark_errors", "A stage or job was aborted: read the first task failure, later ones mostly follow from it"),
    ("io_errors", "Files could not be read or written: list the named path with the job's own identity"),
)

# What to do first for the patterns of a label; as many steps as the patterns call for.
SOLUTIONS: dict[str, tuple[str, ...]] = {
    "Memory Management": (
        "Find out whether driver or executor ran out: collected results and broadcasts fill the driver, tasks the executor",
        "Compare the largest task of the failed stage with the median; a wide gap means skew, not a small heap",
        "Split the input of that stage into more partitions before raising any memory setting",
        "For a container killed from outside, raise the memory overhead, because the heap was not what grew",
    ),
    "SQL Analysis": (
        "Run the failing statement with LIMIT 0 to separate name errors from data errors",
        "Print the schema of the input that the message names and search it for the missing column",
        "After a schema change upstream, refresh the table's metadata",
    ),
    "Spark Execution": (
        "Open the failed stage and read the error of its first failed attempt",
        "If one partition fails each time, look at its rows; if hosts differ each time, look at the nodes",
        "After lost executors, check whether they were taken back by the cloud or killed for memory",
        "Write intermediate results before long stages, so that a retry starts late",
    ),
    "Application Runtime": (
        "Take the lowest frame of the trace that belongs to your packages and reproduce it with one record",
        "Count nulls in the fields that this line reads",
    ),
    "File I/O": (
        "Look up when the missing file was last written and which job replaces that folder",
        "Read the path from a notebook on the same cluster to tell a wrong path from a missing grant",
        "If files vanish while a job reads them, read a fixed snapshot of the table",
    ),
    "Network": (
        "Resolve and reach the named host and port from a worker, not from the driver alone",
        "For time-outs under load, look at pauses for garbage collection before touching time limits",
        "Retry calls to outside services with growing waits",
    ),
    "Serialization": (
        "Find the object named in the message and build it inside the task instead of capturing it",
        "Copy the few fields a closure needs to local variables, so that it does not carry its whole class",
    ),
    "Configuration": (
        "Compare the effective settings of a good run with those of this run",
        "Check for two versions of the class named in the message on the class path",
        "Restart the cluster after a library change, since running executors keep the old one",
    ),
    "Authentication & Security": (
        "Check the expiry of the token or key before anything else",
        "Ask for the exact action and resource that were refused and grant only these",
        "For certificate errors, compare clocks and the chain that the server sends",
    ),
    "Database": (
        "Tell refused connections, refused statements and broken transactions apart by the error code",
        "Limit the number of partitions that write at once to what the database accepts",
        "After a deadlock, write rows in the order of their key",
    ),
    "Performance": (
        "Find the stage that holds most of the time and ask whether it waits, spills or computes",
        "Filter and select columns before joins, and check that filters reach the scan",
        "Replace many small input files by fewer large ones",
    ),
    "Critical Keywords": (
        "Read the lines before the first critical one; the cause mostly stands above the symptom",
        "Check whether other clusters show the same line at the same hour",
    ),
}

LEVELS_DDL = (
    "catalog STRING, level INT, error_type STRING, category STRING, severity STRING, "
    "priority INT, pattern_idx INT, pattern STRING"
)


def as_catalog(patterns: Catalog | Mapping[str, Iterable[str]]) -> Catalog:
    """Accept a catalog or a plain ``{category: [regex, ...]}`` mapping."""
    if isinstance(patterns, Mapping):
        return tuple(Category(name, tuple(regexes)) for name, regexes in patterns.items())
    return tuple(patterns)


def required_pieces(pattern: str) -> list[str]:
    """Lower-case ASCII texts that every match of ``pattern`` must contain.

    Only words joined by white space, digit or any-text pieces and by plain
    alternations are understood; anything else gives an empty list and is
    always matched in full.
    """
    bare = pattern.replace("(?i)", "").replace(r"\b", "").replace(r"\.", "\x00").lower()
    bare = re.sub(r"\(\?:[a-z|]+\)", ".*", bare)
    pieces = re.split(r"\\s[+*]|\\d\+|\\w\+|\.\*", bare)
    if not all(re.fullmatch(r"[a-z0-9: \x00]*", piece) for piece in pieces):
        return []
    return [piece.replace("\x00", ".") for piece in pieces if piece]


def required_text(pattern: str) -> str | None:
    """The longest of the required pieces, usually the rarest one."""
    return max(required_pieces(pattern), key=len, default=None)


_ONE_OF = re.compile(r"(?:\\b)?\(\?:([A-Za-z]+(?:\|[A-Za-z]+)+)\)(?![?*{])")


def alternative_words(pattern: str) -> tuple[list[str], list[str]]:
    """For a pattern that begins with a choice of words: these words, and short ones that every match has as well.

    A choice behind other pieces, one that may be left out, and patterns with
    further choices or brackets give empty lists.
    """
    bare = pattern.replace("(?i)", "", 1) if pattern.startswith("(?i)") else pattern
    choice = _ONE_OF.match(bare)
    rest = bare[choice.end():] if choice else ""
    if not choice or "|" in rest or "\\\\" in rest or re.search(r"(?<!\\)[()]|\\[QE]", rest):
        return [], []
    return choice[1].lower().split("|"), [w.lower() for w in re.findall(r"\\b([A-Za-z]+)\\s\+", rest)]


def shared_stems(patterns: Iterable[str]) -> dict[str, str]:
    """A stem for each pattern, few in all: texts without a stem cannot match.

    Most patterns share words such as "failed" or "exception". Testing a text
    for these few words first rules out most patterns at once.
    """
    pieces = {p: required_pieces(p) for p in dict.fromkeys(patterns)}
    open_patterns = {p for p, found in pieces.items() if found}
    words = sorted({w for found in pieces.values() for w in re.findall(r"[a-z]{4,}", " ".join(found))})
    stems: dict[str, str] = {}
    while open_patterns:
        covered = {
            w: [p for p in open_patterns if any(w in piece for piece in pieces[p])] for w in words
        }
        best = max(words, key=lambda w: (len(covered[w]), len(w)), default=None)
        if best is None or not covered[best]:
            break
        stems.update(dict.fromkeys(covered[best], best))
        open_patterns.difference_update(covered[best])
    return stems


def valid_patterns(
    spark: SparkSession, patterns: Catalog | Mapping[str, Iterable[str]]
) -> tuple[Catalog, DataFrame]:
    """Split a caller's catalog into usable patterns and ``rejected_patterns``.

    All regexes are tried at once against an empty literal; only if one of them
    is bad, which would otherwise fail the job at run time, is each tried alone.
    Category names survive even when all of their patterns are rejected.
    """
    catalog = as_catalog(patterns)
    schema = "category STRING, pattern_idx INT, pattern STRING, reason STRING"
    every = [F.lit("").rlike(p) for cat in catalog for p in cat.patterns]
    try:
        spark.range(1).select(F.array(*every)).collect()
        return catalog, spark.createDataFrame([], schema)
    except PySparkException:
        pass  # the search for the bad ones follows
    kept, rejected = [], []
    for cat in catalog:
        good = []
        for idx, pattern in enumerate(cat.patterns):
            try:
                spark.range(1).select(F.lit("").rlike(pattern)).collect()
                good.append(pattern)
            except PySparkException as err:
                reason = str(err).splitlines()[0] if str(err) else "invalid regex"
                rejected.append((cat.name, idx, pattern, reason))
        kept.append(Category(cat.name, tuple(good), cat.severity, cat.label, cat.priority))
    return tuple(kept), spark.createDataFrame(rejected, schema)


def catalog_rows(name: str, catalog: Catalog, level: int | None = None) -> list[tuple]:
    return [
        (name, level, cat.name, cat.label, cat.severity, cat.priority, idx, pattern)
        for cat in catalog
        for idx, pattern in enumerate(cat.patterns)
    ]


def catalog_df(spark: SparkSession) -> DataFrame:
    """All built-in catalogs as one small reference table."""
    rows = catalog_rows("analysis", ANALYSIS_CATALOG) + catalog_rows("search", SEARCH_CATALOG)
    for number, catalog in enumerate(LEVEL_CATALOGS, start=1):
        rows += catalog_rows("level", catalog, number)
    rows += catalog_rows("quick", QUICK_CATALOG)
    return spark.createDataFrame(rows, LEVELS_DDL)


def solution_df(spark: SparkSession) -> DataFrame:
    """One row per remedy, in order."""
    rows = [(label, i, text) for label, texts in SOLUTIONS.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "category STRING, solution_idx INT, text STRING")


def solution_text(label: str) -> str:
    return "; ".join(SOLUTIONS.get(label, ()))


def focus_categories(areas: Iterable[str]) -> list[str]:
    """Resolve focus areas; an unknown area is taken as a category name."""
    out: list[str] = []
    for area in areas:
        out += [c for c in FOCUS_AREAS.get(area, (area,)) if c not in out]
    return out

"""Queries over the lines of source files that derive from the business tables: sections, declarations, signals, rules, manifests,
coverage. Where an oracle doesn't read the lines, it says what follows from the tables' columns by the templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import source_lines as S
from sparkloom.plans.derived import LINES_SQL, UNITS, source_lines
from sparkloom.plans.derived import values as _values
from sparkloom.sources.files import language_of

#: Lines that declare a function.
SIGNATURE = r"^\s*(def |func |pub.* fn |fn |private static )"


def _lines(spark: SparkSession, d: str, like: str = "") -> DataFrame:
    rows = source_lines(spark, d)
    return rows.where(F.col("file").rlike(like)) if like else rows


def _declared(spark: SparkSession, d: str) -> DataFrame:
    return S.declarations(_lines(spark, d), language_of(F.col("file")))


def _python(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d, "[.]py$")
    return S.python_blocks(lines, S.declarations(lines, F.lit("python")))


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return S.sections(_lines(spark, d, "[.]md$"))


def front_matter_fields(spark: SparkSession, d: str) -> DataFrame:
    return S.front_matter(_lines(spark, d, "[.]md$"))


def declarations_by_language(spark: SparkSession, d: str) -> DataFrame:
    return _declared(spark, d)


def python_spans(spark: SparkSession, d: str) -> DataFrame:
    return _python(spark, d)


def python_nesting(spark: SparkSession, d: str) -> DataFrame:
    return S.python_nesting(_lines(spark, d), _python(spark, d).where("kind = 'function'"))


def brace_depth(spark: SparkSession, d: str) -> DataFrame:
    return S.brace_depth(_lines(spark, d, "[.](go|rs|java)$"))


def parameter_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d, "^src/").where(F.col("line").rlike(SIGNATURE))
    return lines.select("file", "line_no", S.param_count(F.col("line")).alias("n"))


def line_signals(spark: SparkSession, d: str) -> DataFrame:
    return S.signal_hits(_lines(spark, d, "^src/"))


def placeholder_functions(spark: SparkSession, d: str) -> DataFrame:
    return S.placeholders(_lines(spark, d, "^src/"), _python(spark, d))


def unused_imports(spark: SparkSession, d: str) -> DataFrame:
    return S.unused_imports(_lines(spark, d, "[.]py$"))


def dead_declarations(spark: SparkSession, d: str) -> DataFrame:
    return S.dead_declarations(_declared(spark, d).where("file LIKE '%.py'"), _lines(spark, d, "[.]py$"))


def workflow_rules(spark: SparkSession, d: str) -> DataFrame:
    return S.workflow_hits(_lines(spark, d, "^[.]github/"))


def manifest_rules(spark: SparkSession, d: str) -> DataFrame:
    return S.manifest_hits(_lines(spark, d, "^k8s/"))


def required_packages(spark: SparkSession, d: str) -> DataFrame:
    return S.requirements(_lines(spark, d))


def coverage_formats(spark: SparkSession, d: str) -> DataFrame:
    return S.coverage_lines(_lines(spark, d, "^cov/"))


def large_files(spark: SparkSession, d: str) -> DataFrame:
    return S.large_files(_lines(spark, d), 20)


QUERIES = {
    f.__name__: f
    for f in (
        markdown_sections, front_matter_fields, declarations_by_language, python_spans, python_nesting, brace_depth, parameter_counts, line_signals, placeholder_functions, unused_imports, dead_declarations,
        workflow_rules, manifest_rules, required_packages, coverage_formats, large_files,
    )
}

_L = LINES_SQL
_UNIT = f"WITH u AS ({UNITS})"
_LANG = "CASE regexp_extract(file, '[.](\\w+)$', 1) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' END"
_KINDS = ", ".join(f"('{lang}', {n}, '{kind}', '{p}')" for lang, kinds in S.DECLARATIONS.items() for n, (kind, p) in enumerate(kinds.items()))
_DECL = f"""k(lang, n, kind, pattern) AS (VALUES {_KINDS}), dm AS (SELECT file, line_no, line, kind, n, pattern FROM l JOIN k ON lang = {_LANG} WHERE regexp_matches(line, pattern)),
    decl AS (SELECT file, line_no, arg_min(kind, n) AS kind, arg_min(regexp_extract(line, pattern, 1), n) AS name, length(regexp_extract(any_value(line), '^(\\s*)', 1))::INTEGER AS indent FROM dm GROUP BY file, line_no)"""
_PY = f"""{_DECL}, c AS (SELECT file, line_no, line, length(regexp_extract(line, '^(\\s*)', 1)) AS i FROM l WHERE trim(line) <> ''),
    py AS (SELECT d.*, (SELECT max(x.line_no) FROM c x WHERE x.file = d.file AND x.line_no >= d.line_no AND x.line_no < coalesce((SELECT min(y.line_no) FROM c y WHERE y.file = d.file AND y.line_no > d.line_no AND y.i <= d.indent), 1000000)) AS end_line
        FROM decl d WHERE d.file LIKE '%.py')"""

ORACLES = {
    "markdown_sections": f"""WITH {_L}, f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS e, max(line_no) OVER (PARTITION BY file) AS size FROM l WHERE file LIKE '%.md'),
        h AS (SELECT file, line_no, size, length(regexp_extract(line, '^(#+)', 1))::INTEGER AS level, trim(replace(regexp_replace(regexp_replace(line, '^#+ +', ''), ' *#* *$', ''), '`', '')) AS t FROM f WHERE e % 2 = 0 AND regexp_matches(line, '^#{{1,6}} +\\S')),
        n AS (SELECT *, t || CASE WHEN row_number() OVER (PARTITION BY file, t ORDER BY line_no) > 1 THEN ' (' || row_number() OVER (PARTITION BY file, t ORDER BY line_no) || ')' ELSE '' END AS title FROM h)
        SELECT file, line_no, coalesce((SELECT min(x.line_no) - 1 FROM n x WHERE x.file = n.file AND x.line_no > n.line_no AND x.level <= n.level), size)::INTEGER AS end_line, level, title,
        (SELECT arg_max(x.title, x.line_no) FROM n x WHERE x.file = n.file AND x.line_no < n.line_no AND x.level < n.level AND NOT EXISTS (SELECT 1 FROM n y WHERE y.file = n.file AND y.line_no > x.line_no AND y.line_no < n.line_no AND y.level <= x.level)) AS parent FROM n""",
    "front_matter_fields": f"""{_UNIT} SELECT 'docs/d' || k || '.md' AS file, unnest(['name', 'tags', 'version']) AS key, unnest(['guide' || k, '[a, ' || name || ']', z::VARCHAR]) AS value FROM u WHERE kind = 4 AND z % 2 = 0""",
    "declarations_by_language": f"WITH {_L}, {_DECL} SELECT * FROM decl",
    "python_spans": f"WITH {_L}, {_PY} SELECT * FROM py",
    "python_nesting": f"""WITH {_L}, {_PY} SELECT py.file, py.name, coalesce(max(CASE WHEN regexp_matches(c.line, '^\\s*(if|for|while|try)\\b') THEN (c.i - py.indent) / 4 END), 0)::INTEGER AS nesting FROM py LEFT JOIN c ON c.file = py.file AND c.line_no > py.line_no AND c.line_no <= end_line WHERE kind = 'function' GROUP BY ALL""",
    "brace_depth": f"""{_UNIT} SELECT 'src/a' || k || '.go' AS file, 2 + z % 2 AS depth FROM u WHERE kind = 1 UNION ALL SELECT 'src/b' || k || '.rs', 1 FROM u WHERE kind = 2 UNION ALL SELECT 'src/C' || k || '.java', 2 FROM u WHERE kind = 3""",
    "parameter_counts": f"""WITH {_L}, c AS (SELECT file, line_no, string_split(regexp_extract(line, '[(](.*)[)][^)]*$', 1), '') AS c FROM l WHERE starts_with(file, 'src/') AND regexp_matches(line, '^\\s*(def |func |pub.* fn |fn |private static )')),
        d AS (SELECT file, line_no, c, list_transform(range(1, len(c) + 1), lambda k: len(list_filter(c[:k], lambda x: x IN ('(', '[', '<'))) - len(list_filter(c[:k], lambda x: x IN (')', ']', '>')))) AS deep FROM c),
        p AS (SELECT file, line_no, list_transform(string_split(array_to_string(list_transform(range(1, len(c) + 1), lambda k: CASE WHEN deep[k] = 0 AND c[k] = ',' THEN chr(31) ELSE c[k] END), ''), chr(31)), lambda x: trim(x)) AS p FROM d)
        SELECT file, line_no, len(list_filter(p, lambda x: x NOT IN ('', 'self', '&self', '*', '/')))::INTEGER AS n FROM p""",
    "line_signals": f"WITH {_L}, {_values([(n, p) for n, p in S.SIGNALS.items()], 's(family, pattern)')} SELECT file, line_no, family FROM l JOIN s ON regexp_matches(line, pattern) WHERE file LIKE 'src/%'",
    "placeholder_functions": f"WITH {_L}, {_PY} SELECT l.file, l.line_no, arg_max(name, py.line_no) AS name FROM l LEFT JOIN py ON py.file = l.file AND l.line_no BETWEEN py.line_no AND end_line WHERE l.file LIKE 'src/%' AND regexp_matches(l.line, 'NotImplementedError|todo!') GROUP BY l.file, l.line_no",
    "unused_imports": f"""{_UNIT} SELECT 'src/m' || k || '.py' AS file, 'sys' AS name FROM u WHERE kind = 0 UNION ALL SELECT 'src/m' || k || '.py', 'os' FROM u WHERE kind = 0 AND z % 5 <> 0 UNION ALL SELECT 'src/m' || k || '.py', 'loads' FROM u WHERE kind = 0 AND z % 2 = 0""",
    "dead_declarations": f"""WITH {_L}, {_DECL}, w AS (SELECT file, unnest(regexp_extract_all(line, '[A-Za-z_]\\w*')) AS name FROM l WHERE file LIKE '%.py')
        SELECT file, line_no, name, CASE WHEN (SELECT count(*) FROM w WHERE w.name = decl.name) = 1 THEN 'unused' WHEN (SELECT count(DISTINCT w.file) FROM w WHERE w.name = decl.name) = 1 THEN 'internal' ELSE 'used' END AS verdict FROM decl WHERE file LIKE '%.py'""",
    "workflow_rules": f"""WITH {_L}, w AS (SELECT *, min(CASE WHEN line = 'jobs:' THEN line_no END) OVER f AS jobs, bool_or(contains(line, 'pull_request')) OVER f AS open, bool_or(line = 'permissions:') OVER f AS perms FROM l WHERE starts_with(file, '.github/') WINDOW f AS (PARTITION BY file))
        SELECT file, line_no, CASE WHEN contains(line, 'issue.title') THEN 'template-injection' WHEN contains(line, 'checkout@v') THEN 'unpinned-action' WHEN contains(line, 'secrets.KEY') THEN 'secret-exposure' WHEN contains(line, 'curl') THEN 'pipe-to-shell' ELSE 'self-hosted' END AS rule
        FROM w WHERE regexp_matches(line, 'issue[.]title|checkout@v|secrets[.]KEY|curl') OR (open AND contains(line, 'self-hosted')) UNION ALL SELECT DISTINCT file, 1, 'permissions' FROM w WHERE open AND NOT perms""",
    "manifest_rules": f"""WITH {_L}, m AS (SELECT * FROM l WHERE starts_with(file, 'k8s/')), u AS ({UNITS}), f AS (SELECT 'k8s/s' || k || '.yml' AS file, z FROM u WHERE kind = 6)
        SELECT file, line_no, CASE WHEN contains(line, 'nginx') THEN 'mutable-image' ELSE 'privileged' END AS rule FROM m WHERE contains(line, 'nginx') OR contains(line, 'privileged')
        UNION ALL SELECT file, 1, 'root' FROM f WHERE z % 3 <> 2 UNION ALL SELECT file, 3, 'no-limits' FROM f WHERE z % 4 <> 1 UNION ALL SELECT file, line_no, 'rbac-wildcard' FROM m WHERE contains(line, '"*"')
        UNION ALL SELECT file, line_no, 'ingress-no-tls' FROM m JOIN f USING (file) WHERE line = 'kind: Ingress' AND z % 4 <> 0""",
    "required_packages": f"""{_UNIT} SELECT 'requirements-' || k || '.txt' AS file, 'pypi' AS ecosystem, unnest(['requests', 'flask' || k]) AS name, unnest(['==2.' || z, '>=2,<' || z]) AS spec FROM u WHERE kind = 7 UNION ALL SELECT 'requirements-' || k || '.txt', 'pypi', name, '' FROM u WHERE kind = 7 AND z % 2 = 0
        UNION ALL SELECT 'v' || k || '/go.mod', 'go', unnest(['github.com/a/' || name, 'golang.org/x/c' || k]), unnest(['v1.' || z || '.3', 'v0.1.0']) FROM u WHERE kind = 8
        UNION ALL SELECT 'v' || k || '/Cargo.toml', 'cargo', unnest(['serde', 'tokio' || k]), unnest(['1.' || z, '1.2']) FROM u WHERE kind = 9 UNION ALL SELECT 'v' || k || '/Cargo.toml', 'cargo', 'rand', '0.8' FROM u WHERE kind = 9 AND z % 2 = 0""",
    "coverage_formats": f"""{_UNIT} SELECT 'a/x' || k || '.go' AS path, unnest([1, 2, 3, 4]) AS line, unnest([z, z, greatest(z, 4), 4]) AS hits FROM u WHERE kind = 10 UNION ALL SELECT 'p/k' || k || '.py', unnest([1, 2]), unnest([z, 0]) FROM u WHERE kind = 11
        UNION ALL SELECT 'p/l' || k || '.py', 1, z FROM u WHERE kind = 11 AND z % 2 = 0 UNION ALL SELECT 'J' || k || '.java', unnest([7, 8]), unnest([z, 0]) FROM u WHERE kind = 12""",
    "large_files": f"WITH {_L} SELECT file, count(*) AS n_lines FROM l GROUP BY file HAVING count(*) > 20",
}

"""Source files as rows of lines: sections, declarations, signals, nesting, unused names, workflow and manifest rules.

lines(file, line_no, line) is the input throughout. Windows run over a file, which is small beside a table of files; very large
generated files are a matter of Spark's spilling, for no file is gathered in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import code

#: Declarations by language: kind -> pattern whose group is the name.
DECLARATIONS = {
    "python": {"function": r"^\s*(?:async\s+)?def\s+(\w+)", "class": r"^\s*class\s+(\w+)"},
    "go": {"method": r"^func\s+\([^)]*\)\s+(\w+)", "function": r"^func\s+(\w+)", "struct": r"^type\s+(\w+)\s+struct\b", "interface": r"^type\s+(\w+)\s+interface\b"},
    "rust": {"function": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "struct": r"^\s*(?:pub\s+)?struct\s+(\w+)", "trait": r"^\s*(?:pub\s+)?trait\s+(\w+)", "module": r"^\s*(?:pub\s+)?mod\s+(\w+)"},
    "java": {"class": r"\b(?:class|record)\s+(\w+)", "interface": r"\binterface\s+(\w+)", "method": r"^\s+(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\], ]+\s+(\w+)\s*\("},
}
#: Line signals by family.
SIGNALS = {
    "route": r"@(?:app|router)\.(?:get|post|put|delete|patch)\(|\brouter\.(?:get|post)\(|@(?:Get|Post|Request)Mapping\b", "cli": r"\bargparse\b|\.add_argument\(|\bcobra\.Command\b|@click\.command",
    "env": r"\bos\.environ\b|\bgetenv\(|process\.env\.", "database": r"\.execute\(|\bSELECT\s.+\sFROM\b|\.objects\.", "http-call": r"\brequests\.(?:get|post)\(|\bfetch\(|http\.Get\(",
    "file-write": r"open\([^)]*['\"]w|\bWriteFile\(|fs\.write", "process": r"\bsubprocess\.|\bexec\.Command\(|Runtime\.getRuntime", "log": r"\blogging\.|\blogger\.|console\.log\(|\blog\.",
}
PLACEHOLDER = r"NotImplementedError|not implemented|unimplemented!\(|todo!\(|UnsupportedOperationException"
BLOCK = r"^\s*(?:async\s+)?(if|elif|else|for|while|try|except|finally|with|match|case)\b"


def indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(\s*)", 1))


def _in_file(*order: str) -> Window:
    return Window.partitionBy("file").orderBy(*(order or ("line_no",)))


def outside_fences(lines: DataFrame) -> DataFrame:
    """Lines of Markdown that are in no code fence, nor one's edge."""
    edge = F.col("line").rlike(r"^\s*(```|~~~)").cast("int")
    return lines.withColumn("_edges", F.sum(edge).over(_in_file())).where((F.col("_edges") % 2 == 0) & (edge == 0)).drop("_edges")


def sections(lines: DataFrame) -> DataFrame:
    """(file, line_no, end_line, level, title, parent): headings with the last line of their section, and the title of the one
    that they are under. Equal titles of a file are numbered."""
    found = outside_fences(lines).where(F.col("line").rlike(r"^#{1,6}\s+\S"))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"^#{1,6}\s+", ""), r"\s*#*\s*$", ""), "`", ""))
    heads = found.select("file", "line_no", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), title.alias("title"))
    again = F.row_number().over(Window.partitionBy("file", "title").orderBy("line_no"))
    heads = heads.withColumn("_n", again).withColumn("title", F.when(F.col("_n") > 1, F.concat("title", F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(F.col("title"))).drop("_n")
    size = lines.groupBy("file").agg(F.max("line_no").alias("_size"))
    # six levels at most: the nearest heading of each level before and after
    upto, after = _in_file().rowsBetween(Window.unboundedPreceding, -1), _in_file().rowsBetween(1, Window.unboundedFollowing)
    before = [F.max(F.when(F.col("level") == n, F.struct("line_no", "title"))).over(upto).alias(f"_b{n}") for n in range(1, 7)]
    nexts = [F.min(F.when(F.col("level") <= n, F.col("line_no"))).over(after).alias(f"_a{n}") for n in range(1, 7)]
    rows = heads.select("*", *before, *nexts)
    parent = F.coalesce(*[F.when(F.col("level") == n, F.greatest(F.lit(None).cast("struct<line_no:int,title:string>"), *[F.col(f"_b{k}") for k in range(1, n)]) if n > 2 else F.col("_b1") if n == 2 else F.lit(None)) for n in range(2, 7)])
    end = F.coalesce(*[F.when(F.col("level") == n, F.col(f"_a{n}")) for n in range(1, 7)])
    out = rows.select("file", "line_no", "level", "title", parent["title"].alias("parent"), end.alias("_next"))
    return out.join(size, "file").select("file", "line_no", F.coalesce(F.col("_next") - 1, F.col("_size")).alias("end_line"), "level", "title", "parent")


def front_matter(lines: DataFrame) -> DataFrame:
    """(file, key, value): the simple fields between the dashes at the start of a file."""
    mark = F.col("line").rlike(r"^---\s*$").cast("int")
    rows = lines.withColumn("_marks", F.sum(mark).over(_in_file())).withColumn("_first", F.first(mark).over(_in_file()))
    held = rows.where((F.col("_first") == 1) & (F.col("_marks") == 1) & (mark == 0) & F.col("line").rlike(r"^[A-Za-z_][\w-]*:\s*\S"))
    value = F.regexp_replace(F.trim(F.regexp_extract("line", r"^[^:]*:\s*(.*)$", 1)), r"^[\"'](.*)[\"']$", "$1")
    return held.select("file", F.regexp_extract("line", r"^([A-Za-z_][\w-]*):", 1).alias("key"), value.alias("value"))


def declarations(lines: DataFrame, language: Column) -> DataFrame:
    """(file, line_no, kind, name, indent): what a line declares, by the first pattern of its language that fits."""
    found = None
    for lang, kinds in DECLARATIONS.items():
        for kind, pattern in kinds.items():
            hit = (language == lang) & F.col("line").rlike(pattern)
            value = F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", pattern, 1).alias("name"))
            found = F.when(hit, value) if found is None else found.when(hit, value)
    return lines.select("file", "line_no", found.alias("d"), indent(F.col("line")).alias("indent")).where("d IS NOT NULL").select("file", "line_no", "d.kind", "d.name", "indent")


def python_blocks(lines: DataFrame, declared: DataFrame, deepest: int = 100) -> DataFrame:
    """declared with end_line: the last line before code that is indented no further.

    A line is put once beside each depth that declarations have (deeper ones than `deepest` count as that deep) and that it could
    stop; the next such line behind a declaration ends it. Rows are lines times the few depths, never lines times declarations."""
    code_rows = lines.where(F.trim("line") != "").select("file", "line_no", F.least(indent(F.col("line")), F.lit(deepest)).alias("_in"))
    depths = declared.select(F.least("indent", F.lit(deepest)).alias("_in")).distinct()
    stops = code_rows.join(F.broadcast(depths.withColumnRenamed("_in", "_depth")), F.col("_in") <= F.col("_depth"))  # depths: `deepest` rows at most
    own = declared.select("file", F.col("line_no").alias("_at"), F.least("indent", F.lit(deepest)).alias("_depth")).distinct()
    w = Window.partitionBy("file", "_depth").orderBy("line_no")
    following = stops.select("file", "_depth", "line_no", F.lead("line_no").over(w).alias("_stop"))
    before = Window.partitionBy("file").orderBy("line_no")
    last = code_rows.select("file", F.col("line_no").alias("_stop"), F.lag("line_no").over(before).alias("_end"))
    whole = code_rows.groupBy("file").agg(F.max("line_no").alias("_last"))
    found = own.join(following.withColumnRenamed("line_no", "_at"), ["file", "_depth", "_at"], "left").join(last, ["file", "_stop"], "left").join(whole, "file")
    ends = found.select("file", F.col("_at").alias("line_no"), F.coalesce("_end", "_last").alias("end_line"))
    return declared.join(ends, ["file", "line_no"]).select(*declared.columns, "end_line")


def python_nesting(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, name, nesting): the deepest block statements in each function, by indentation in steps of its body's."""
    rows = functions.select("file", "name", F.col("line_no").alias("_a"), F.col("end_line").alias("_b"), F.col("indent").alias("_base"))
    inner = lines.where(F.trim("line") != "").join(rows, "file").where("line_no > _a AND line_no <= _b").withColumn("_in", indent(F.col("line")))
    unit = inner.groupBy("file", "name").agg(F.min("_in").alias("_first"), F.max("_base").alias("_base"))
    blocks = inner.where(F.col("line").rlike(BLOCK) & ~F.col("line").rlike(r"^\s*(with|case)\b")).select("file", "name", "_in")
    deep = blocks.join(unit, ["file", "name"]).groupBy("file", "name").agg(F.max(F.floor((F.col("_in") - F.col("_first")) / F.greatest(F.lit(1), F.col("_first") - F.col("_base"))) + 1).alias("nesting"))
    return functions.select("file", "name").join(deep, ["file", "name"], "left").select("file", "name", F.coalesce("nesting", F.lit(0)).cast("int").alias("nesting"))


def brace_depth(lines: DataFrame) -> DataFrame:
    """(file, depth): the deepest nesting of braces, strings and comments apart."""
    plain = code.strip_comment(code.strip_strings(F.col("line")))
    n = lambda c: F.length(plain) - F.length(F.replace(plain, F.lit(c), F.lit("")))
    rows = lines.withColumn("_open", n("{")).withColumn("_net", n("{") - n("}"))
    before = F.coalesce(F.sum("_net").over(_in_file().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_depth", before + F.col("_open")).groupBy("file").agg(F.max("_depth").cast("int").alias("depth"))


def param_count(signature: Column) -> Column:
    """Parameters between the first brackets, those of brackets inside apart; self, cls and bare stars don't count."""
    inner = F.regexp_extract(signature, r"\((.*)\)[^)]*$", 1)
    for _ in range(4):  # brackets inside brackets, from the inside out
        inner = F.regexp_replace(inner, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>", "")
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^(self|cls|&?(mut\s+)?self|\*|\*\*|/)$"))
    return F.size(parts)


def signal_hits(lines: DataFrame, families: dict[str, str] | None = None) -> DataFrame:
    """(file, line_no, family): all families that a line speaks of."""
    tests = [F.when(F.col("line").rlike(p), F.lit(n)) for n, p in (families or SIGNALS).items()]
    return lines.select("file", "line_no", F.explode(F.array_compact(F.array(*tests))).alias("family"))


def placeholders(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, line_no, name): lines that say that something isn't there yet, with the innermost declaration around them."""
    hits = lines.where(F.col("line").rlike(PLACEHOLDER)).select("file", "line_no")
    s = spans.select(F.col("file").alias("_f"), F.col("line_no").alias("_a"), F.col("end_line").alias("_b"), "name")
    around = hits.join(s, F.expr("file = _f AND line_no BETWEEN _a AND _b"), "left")
    return around.groupBy("file", "line_no").agg(F.max_by("name", "_a").alias("name"))


def unused_imports(lines: DataFrame) -> DataFrame:
    """(file, name): names that a Python file imports and has nowhere else."""
    plain = F.regexp_replace("line", r"\s*#.*$", "")
    imported = F.coalesce(
        F.when(plain.rlike(r"^\s*from\s+\S+\s+import\s"), F.regexp_extract(plain, r"\bimport\s+\(?(.*?)\)?\s*$", 1)), F.when(plain.rlike(r"^\s*import\s"), F.regexp_extract(plain, r"^\s*import\s+(.*?)\s*$", 1))
    )
    names = F.transform(F.split(imported, r"\s*,\s*"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^.*\s+as\s+", ""), r"\..*$", ""))
    own = lines.where(imported.isNotNull()).select("file", F.explode(names).alias("name")).where("name RLIKE '^[A-Za-z_]'").distinct()
    used = lines.where(imported.isNull()).select("file", F.explode(F.regexp_extract_all(code.strip_comment(F.col("line")), F.lit(r"([A-Za-z_]\w*)"), 1)).alias("name")).distinct()
    return own.join(used, ["file", "name"], "left_anti")


def dead_declarations(declared: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, line_no, name, verdict): declarations by where else their name stands: nowhere (unused), in their own file only
    (internal), or in others too (used). Words of all files are counted before they are joined."""
    words = lines.select("file", F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z_]\w*)"), 1)).alias("name")).groupBy("name", "file").agg(F.count("*").alias("n"))
    total = words.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("files"))
    verdict = F.when(F.col("n") <= 1, "unused").when(F.col("files") == 1, "internal").otherwise("used")
    return declared.join(total, "name").select("file", "line_no", "name", verdict.alias("verdict"))


def large_files(lines: DataFrame, most: int = 1000) -> DataFrame:
    return lines.groupBy("file").agg(F.count("*").alias("n_lines")).where(F.col("n_lines") > most)


UNTRUSTED = r"\$\{\{\s*github\.(?:event\.(?:issue|pull_request|comment|review|head_commit)[\w.]*\.(?:title|body|message|ref)|head_ref)\b"


def workflow_hits(lines: DataFrame) -> DataFrame:
    """(file, line_no, rule) of CI workflows: untrusted text in scripts, actions that aren't pinned, wide permissions, secrets
    that are shown, scripts from the network, and a missing permissions block where others can start the run."""
    rows = lines.select("file", "line_no", F.regexp_replace("line", r"\s+#.*$", "").alias("l"))
    jobs = F.min(F.when(F.col("l").rlike("^jobs:"), F.col("line_no"))).over(Window.partitionBy("file"))
    whole = Window.partitionBy("file")
    head = F.coalesce(F.col("line_no") < jobs, F.lit(True))
    rows = rows.withColumn("_open", F.max(head & F.col("l").rlike(r"\bpull_request(_target)?\b|\bissue_comment\b|\bissues\b|\bdiscussion\b|\bfork\b")).over(whole))
    rows = rows.withColumn("_perms", F.max(F.col("l").rlike("^permissions:")).over(whole))
    # the block that a line is in: the last line of a key that is indented less, here that of run
    rows = rows.withColumn("_in", indent(F.col("l"))).withColumn("_run", F.last(F.when(F.col("l").rlike(r"^\s*-?\s*run:\s*[|>]-?\s*$"), F.struct("line_no", "_in")), True).over(_in_file()))
    low = F.min(F.when(F.trim("l") != "", F.col("_in"))).over(Window.partitionBy("file", F.col("_run.line_no")).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    first = F.col("_run.line_no") == F.col("line_no")
    rows = rows.withColumn("_script", F.col("l").rlike(r"^\s*-?\s*run:") | (F.col("_run").isNotNull() & ~first & (low >= F.col("_run._in")) & (F.col("_in") > F.col("_run._in"))))
    action = r"^\s*-?\s*uses:\s*([^\s@]+)@(\S+)"
    tests = {
        "template-injection": F.col("_script") & F.col("l").rlike(UNTRUSTED),
        "unpinned-action": F.col("l").rlike(action) & ~F.regexp_extract("l", action, 1).rlike(r"^(\./|docker://)") & ~F.regexp_extract("l", action, 2).rlike("^[0-9a-f]{40}$"),
        "permissions": F.col("l").rlike(r"^\s*permissions:\s*write-all\b") | (F.col("_open") & F.col("l").rlike(r"^\s*(contents|packages|actions|id-token|pull-requests|deployments|security-events):\s*write\b")),
        "secret-exposure": F.col("l").rlike(r"\becho\b.*\$\{\{\s*secrets\.[A-Z0-9_]+\s*\}\}|^\s*secrets:\s*inherit\b"),
        "self-hosted": F.col("_open") & F.col("l").rlike(r"runs-on:.*self-hosted"),
        "pipe-to-shell": F.col("l").rlike(r"\b(curl|wget)\b[^|]*\|\s*(sudo\s+)?(ba|z)?sh\b"),
    }
    hits = rows.select("file", "line_no", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))).alias("rule"))
    bare = rows.groupBy("file").agg(F.max("_open").alias("o"), F.max("_perms").alias("p")).where("o AND NOT p").select("file", F.lit(1).alias("line_no"), F.lit("permissions").alias("rule"))
    return hits.union(bare)


def manifest_hits(lines: DataFrame) -> DataFrame:
    """(file, line_no, rule) of cluster manifests, document by document: privileged settings, root users, mutable images,
    missing limits, wildcard roles and ingress without certificates."""
    rows = lines.select("file", "line_no", F.trim(F.regexp_replace("line", r"\s+#.*$", "")).alias("l"), F.col("line").alias("raw"))
    rows = rows.withColumn("doc", F.sum(F.col("raw").rlike(r"^---\s*$").cast("int")).over(_in_file()))
    image = F.regexp_extract("l", r"^-?\s*image:\s*[\"']?([^\"'\s]+)", 1)
    tests = {
        "privileged": F.col("l").rlike(r"^(privileged|hostNetwork|hostPID|hostIPC|allowPrivilegeEscalation):\s*true\b|^-?\s*hostPath:"),
        "root": F.col("l").rlike(r"^runAsUser:\s*0\b"), "mutable-image": (image != "") & code.image_is_mutable(image),
    }
    hits = rows.select("file", "line_no", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))).alias("rule"))
    has = lambda p: F.coalesce(F.max(F.col("l").rlike(p)), F.lit(False))
    docs = rows.groupBy("file", "doc").agg(
        F.max(F.when(F.col("raw").rlike("^kind:"), F.regexp_extract("raw", r"^kind:\s*(\w+)", 1))).alias("kind"), F.min(F.when(F.col("raw").rlike("^kind:"), F.col("line_no"))).alias("at"),
        has(r"^runAsNonRoot:\s*true|^runAsUser:\s*[1-9]").alias("user"), has("^containers:").alias("containers"), has("^limits:").alias("limits"), F.min(F.when(F.col("l").rlike("^containers:"), F.col("line_no"))).alias("c_at"),
        has(r"\b(verbs|resources|apiGroups):\s*\[?\s*[\"']\*[\"']|^-\s*[\"']\*[\"']$").alias("any"), F.min(F.when(F.col("l").rlike(r"[\"']\*[\"']"), F.col("line_no"))).alias("any_at"), has("^tls:").alias("tls"),
    )
    works = F.col("kind").isin("Deployment", "StatefulSet", "DaemonSet", "Pod", "Job", "CronJob", "ReplicaSet")
    per = F.array_compact(F.array(
        F.when(works & ~F.col("user"), F.struct(F.col("at").alias("line_no"), F.lit("root").alias("rule"))), F.when(works & F.col("containers") & ~F.col("limits"), F.struct(F.col("c_at").alias("line_no"), F.lit("no-limits").alias("rule"))),
        F.when(F.col("kind").isin("Role", "ClusterRole") & F.col("any"), F.struct(F.col("any_at").alias("line_no"), F.lit("rbac-wildcard").alias("rule"))),
        F.when((F.col("kind") == "Ingress") & ~F.col("tls"), F.struct(F.col("at").alias("line_no"), F.lit("ingress-no-tls").alias("rule"))),
    ))
    return hits.union(docs.select("file", F.explode(per).alias("p")).select("file", "p.line_no", "p.rule"))


def requirements(lines: DataFrame) -> DataFrame:
    """(file, ecosystem, name, spec): packages of requirements.txt, go.mod and Cargo.toml files."""
    name = F.element_at(F.split("file", "/"), -1)
    part = F.last(F.when(F.col("line").rlike(r"^\["), F.regexp_extract("line", r"^\[([^\]]*)\]", 1)), True).over(_in_file())
    rows = lines.withColumn("_part", part)
    py, go, rs = r"^([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*([=<>!~][^;#]*)?", r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+(v\S+)", r"^([\w-]+)\s*=\s*(?:\"([^\"]*)\"|\{.*version\s*=\s*\"([^\"]*)\".*)"
    row = lambda eco, p, spec: F.struct(F.lit(eco).alias("ecosystem"), F.regexp_extract("line", p, 1).alias("name"), F.trim(spec).alias("spec"))
    found = (
        F.when(name.rlike(r"^requirements.*\.txt$") & F.col("line").rlike(py), row("pypi", py, F.regexp_extract("line", py, 2)))
        .when((name == "go.mod") & F.col("line").rlike(go), row("go", go, F.regexp_extract("line", go, 2)))
        .when((name == "Cargo.toml") & F.col("_part").rlike("dependencies$") & F.col("line").rlike(rs), row("cargo", rs, F.concat(F.regexp_extract("line", rs, 2), F.regexp_extract("line", rs, 3))))
    )
    return rows.select("file", found.alias("d")).where("d IS NOT NULL").select("file", "d.*")


def coverage_lines(lines: DataFrame) -> DataFrame:
    """(path, line, hits): Go profiles (file:a.b,c.d statements count), Cobertura and JaCoCo lines, told apart line by line; of
    several counts of a line the largest."""
    go = r"^(\S+\.go):(\d+)\.\d+,(\d+)\.\d+ \d+ (\d+)$"
    named = F.last(F.when(F.col("line").rlike(r"<class\b.*filename=\"|<sourcefile\b.*name=\""), F.regexp_extract("line", r"(?:filename|<sourcefile[^>]*name)=\"([^\"]*)\"", 1)), True).over(_in_file())
    rows = lines.withColumn("_named", named)
    part = lambda p, n: F.regexp_extract("line", p, n)
    cobertura, jacoco = r"<line [^>]*number=\"(\d+)\"[^>]*hits=\"(\d+)\"", r"<line nr=\"(\d+)\"[^>]*ci=\"(\d+)\""
    spans = rows.where(F.col("line").rlike(go)).select(part(go, 1).alias("path"), F.explode(F.sequence(part(go, 2).cast("int"), part(go, 3).cast("int"))).alias("line_no"), part(go, 4).cast("int").alias("hits"))
    xml = rows.where(F.col("line").rlike(f"{cobertura}|{jacoco}")).select(
        F.col("_named").alias("path"), F.coalesce(F.nullif(part(cobertura, 1), F.lit("")), part(jacoco, 1)).cast("int").alias("line_no"), F.coalesce(F.nullif(part(cobertura, 2), F.lit("")), part(jacoco, 2)).cast("int").alias("hits")
    )
    return spans.union(xml).groupBy("path", F.col("line_no").alias("line")).agg(F.max("hits").alias("hits"))

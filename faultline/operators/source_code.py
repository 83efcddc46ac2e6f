"""Extraction from class and trigger sources, as joins and windows over statements.

A source is cut behind every ``{``, ``}`` and ``;`` into statements, one row
each.  Running sums give line, position and brace depth; a ``{`` pairs with the
next ``}`` of its level, which yields blocks; methods, loops, catch handlers
and guards are blocks with a certain header.  What a statement contains
(queries, DML, writes, calls) is found by pattern, and what encloses it by the
last block opened before it.  Windows are per component, that is per one
source text.

Joins are merged at every size: texts made on the way and written rows, which
compress well, are far larger in memory than the planner takes them for, and a
broadcast goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import columns as c
from faultline.functions.scan import scan
from faultline.session import written

KEY = ["org_id", "component_id"]

# ---- fixed values: words and patterns of the language -----------------------
CONTROL = "if for while switch catch else try do return new synchronized finally".split()
VISIBILITIES = "public private protected global".split()
METHOD_HEADER = (
    r"(?is)^\s*(?:@\w+(?:\([^)]*\))?\s*)*([\w<>\[\],.]+(?:\s+[\w<>\[\],.]+)*)\s+(\w+)\s*\(([^)]*)\)\s*\{$"
)
LOOP = r"\b(?:for|while)\s*\("
CATCH = r"catch\s*\(\s*([\w.]+)\s+(\w+)\s*\)"
CLASS_DECL = r"(?is)\b(?:public|private|global)?\s*(?:virtual|abstract)?\s*(with sharing|without sharing|inherited sharing)?\s*\b(class|interface|enum)\s+(\w+)"
QUERY = r"(?is)\[\s*SELECT\b(?:[^\]']++|'(?:[^'\\\n]|\\.)*+'|')*+\]"
DYNAMIC_QUERY = r"(?i)Database\.(?:query|queryWithBinds|getQueryLocator|countQuery)\s*\("
DML = r"(?i)\b(insert|update|delete|upsert|undelete|merge)\s+([A-Za-z_][\w.\[\]]*)"
DML_CALL = r"(?i)Database\.(insert|update|delete|upsert|undelete|merge)\s*\("
STATIC_COLLECTION = r"(?i)\bstatic\s+(final\s+)?(Map|List|Set)\s*<.*?>\s*(\w+)\s*="
FIELD_WRITE = r"\b(\w+)\.([A-Za-z]\w*__c)\s*(?<![!<>=])=(?!=)\s*((?:[^;']++|'(?:[^'\\\n]|\\.)*+'|')++);"
MAP_LOOKUP = r"^\s*(\w+)\s*\.\s*get\s*\("
CALLOUT = r"(?i)new\s+HttpRequest\s*\(|\bHttp\s*\(\)\s*\.\s*send|WebServiceCallout\.invoke|@future\s*\(\s*callout\s*=\s*true"
CREDENTIAL = r"callout:([A-Za-z0-9_/]+)"
THROWN = r"throw\s+new\s+([\w.]+)"
CUSTOM_EXCEPTION = r"\bclass\s+(\w+)\s+extends\s+Exception\b"
TRIGGER = r"(?i)trigger\s+(\w+)\s+on\s+([\w.]+)\s*\(([^)]*)\)"
CALL = r"(?<![\w.])((?:[A-Za-z_]\w*\.)+)([A-Za-z_]\w*)\s*\("
BARE_CALL = r"(?<![\w.])([A-Za-z_]\w*)\s*\("
NEW = r"\bnew\s+([A-Za-z_]\w*)(?:\s*\.\s*([A-Za-z_]\w*))?\s*\("
FOR_NAME = r"(?i)\bType\s*\.\s*forName\s*\(\s*(?:'[\w]*'\s*,\s*)?'([\w.]+)'\s*\)"
CUSTOM_OBJECT = r"\b[A-Za-z][A-Za-z0-9_]*__(?:c|mdt|e|b)\b"
STANDARD_OBJECTS = (
    "Account Contact Opportunity OpportunityLineItem Lead Case Campaign CampaignMember Contract Order OrderItem "
    "Product2 PricebookEntry Pricebook2 User UserRole Group Task Event Attachment ContentDocument ContentDocumentLink "
    "ContentVersion Quote QuoteLineItem Asset RecordType Profile PermissionSet Territory2 Territory2Model ContentNote "
    "EmailMessage Note"
).split()
SYSTEM_CLASSES = (
    "System Database Schema Test JSON Http Limits UserInfo Datetime Date Math String Integer Decimal EventBus "
    "Messaging ApexPages Trigger Type Blob"
).split()
COLLECTION_METHODS = (
    "get put add addall remove removeall size isempty clear contains containskey keyset values putall sort clone split "
    "substring tolowercase touppercase trim replace replaceall startswith endswith indexof length format valueof "
    "abbreviate equals hashcode tostring charat join left right deepclone"
).split()
# mechanism -> (position of the job argument, positions of what else is told)
DISPATCH = {
    "System.enqueueJob": (0, {"delay_minutes": 1}),
    "Database.executeBatch": (0, {"scope_size": 1}),
    "System.scheduleBatch": (0, {"job_name": 1, "delay_minutes": 2, "scope_size": 3}),
    "System.schedule": (2, {"job_name": 0, "cron": 1}),
}
DISPATCH_CALL = r"(?i)\b(System\s*\.\s*(?:enqueueJob|scheduleBatch|schedule)|Database\s*\.\s*executeBatch)\s*\("
JOB_INTERFACES = "queueable schedulable database.batchable object system.queueable system.schedulable".split()
NOT_TYPES = "final static public private protected global transient".split()
# namespaces of the platform, which are no classes of the org
NAMESPACES = (
    "ConnectApi Auth Approval Cache Search Site Dom Process Flow Crypto EncodingUtil Url Label Pattern Matcher Http HttpRequest "
    "HttpResponse Exception PageReference Id Boolean Long Double List Set Map Object SObject Savepoint Time Metadata Reports "
    "QuickAction Wave KbManagement Sfc Canvas TxnSecurity Functions"
).split()
LITERAL = r"'(?:[^'\\\n]|\\.)*+'"
# a statement up to its closing brace or semicolon; those inside string literals close nothing
PIECE = rf"(?s)(?:[^{{}};']++|{LITERAL}|')*+(?:[{{}};]|\z)"
# a brace that opens the values of a new collection, not a block
INITIALISER = r"(?is)\bnew\s+[\w.]+(?:\s*<[\w\s.,<>\[\]]*>)?(?:\s*\[\s*\])?\s*\{$"
BRACKETS = rf"(?s){LITERAL}|[()]|[^()']++|'"
INLINE_HEAD = r"^\s*(else\s+if|if|for|while)\s*\("
INLINE_ELSE = r"^\s*else\b(?!\s+if\b)\s*(?=[^\s{;])"
# a comment mark behind a quote may stand inside a literal; the text as literals, comments and the rest
MARK_IN_LITERAL = r"'[^'\n]*(?://|/\*)"
CODE_TOKENS = rf"(?s){LITERAL}|/\*.*?\*/|//[^\n]*|[^'/]++|['/]"
# methods marked as entry points, by annotation
MARKED_METHODS = {
    kind: rf"@{kind}[^\n]*\n\s*(?:public|global|private)?\s*(?:static\s+)?[\w<>\[\],\s]+\s+(\w+)\s*\("
    for kind in ("AuraEnabled", "InvocableMethod", "future", "RemoteAction")
}
REST_RESOURCE = r"(?i)@RestResource\s*\(urlMapping\s*=\s*'([^']*)'"
# what a handler does with its exception
HANDLER_FACTS = {
    "wraps_and_rethrows": r"\bthrow\s+new\b",
    "adds_error": r"\.addError\s*\(",
    "publishes_event": r"EventBus\.publish\s*\(",
    "persists_log": r"(?i)\b(insert|upsert|update)\b|Database\.(insert|upsert)",
    "sends_email": r"Messaging\.sendEmail\s*\(",
    "debug_only": r"System\.debug\s*\(",
}
# a call that is handed a variable, before and behind its name; words that only look like calls
HANDED_TO = (r"\b([A-Za-z_][\w.]*)\s*\([^)]*\b", r"\b")
NO_CALLEES = ("if", "for", "while", "return", "System")
# what the statements must hold that each job reads
QUERY_MARKS = (QUERY, DYNAMIC_QUERY)
DML_MARKS = (DML, DML_CALL)
WRITE_MARKS = (FIELD_WRITE, *DML_MARKS)
FLAG_MARKS = (CATCH, DISPATCH_CALL, *QUERY_MARKS, *WRITE_MARKS)
# words that may stand right before a call
BEFORE_CALL = "return else throw and or not in case when".split()
# -----------------------------------------------------------------------------


def stripped(code: Column) -> Column:
    """The source without comments; comment marks inside string literals are none."""
    plain = F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", "")
    tokens = F.regexp_extract_all(code, F.lit(CODE_TOKENS), 0)
    by_token = F.array_join(F.transform(tokens, lambda t: F.when(t.startswith("/*"), " ").when(t.startswith("//"), "").otherwise(t)), "")
    return F.when(code.rlike(MARK_IN_LITERAL), by_token).otherwise(plain)


def prepared(sources: DataFrame) -> DataFrame:
    return sources.withColumn("raw_code", F.col("code")).withColumn("code", stripped(F.col("code")))


def _pieces(code: Column) -> Column:
    """The source cut behind every brace and semicolon that ends or opens something.

    String literals are passed over.  The braces of an initialiser belong to
    the expression around them, so its pieces are joined to one statement.
    """
    cut = F.filter(F.regexp_extract_all(code, F.lit(PIECE), 0), lambda p: p != "")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        opens = F.when(F.substring(p, -1, 1) == "{", 1).when(F.substring(p, -1, 1) == "}", -1).otherwise(0)
        outside = acc["depth"] == 0
        depth = F.when(outside, F.regexp_like(p, F.lit(INITIALISER)).cast("int")).otherwise(acc["depth"] + opens)
        ends = outside & (depth == 0)
        whole = F.concat(acc["cur"], p)
        return F.struct(
            depth.alias("depth"), F.when(ends, "").otherwise(whole).alias("cur"),
            F.when(ends, F.array_append(acc["out"], whole)).otherwise(acc["out"]).alias("out"),
        )

    joined = F.aggregate(cut, start, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"])))
    return F.when(F.exists(cut, lambda p: F.regexp_like(p, F.lit(INITIALISER))), joined).otherwise(cut)


def _open_parentheses(text: Column) -> Column:
    plain = F.regexp_replace(text, LITERAL, "")
    return F.regexp_count(plain, F.lit(r"\(")) - F.regexp_count(plain, F.lit(r"\)"))


def statements(prep: DataFrame, with_methods: bool = True) -> DataFrame:
    """Statements with line, position and level, the method around them and whether a loop is.

    Triggers have no methods, though their header looks like one.
    """
    rows = prep.select(*KEY, F.posexplode_outer(_pieces(F.col("code"))).alias("no", "text")).filter("text <> ''")
    closer = F.substring("text", -1, 1)
    rows = rows.withColumn("closer", F.when(closer.isin("{", "}", ";"), closer)).withColumn(
        "step", F.when(closer == "{", 1).when(closer == "}", -1).otherwise(0)
    ).withColumn("breaks", F.length("text") - F.length(F.regexp_replace("text", "\n", "")))
    swept = scan(
        rows, KEY, "no", sums={"depth": F.col("step"), "lines": F.col("breaks"), "end_pos": F.length("text")}
    )
    swept = swept.withColumn("start_line", F.col("lines") - F.col("breaks") + 1).withColumn(
        "level", F.when(F.col("step") == 1, F.col("depth") - 1).when(F.col("step") == -1, F.col("depth"))
    )
    same = Window.partitionBy(*KEY, "level").orderBy("no")
    swept = swept.withColumn("close_no", F.when(F.col("step") == 1, F.coalesce(F.lead("no").over(same), F.lit(2**31 - 1)))).withColumn(
        "close_pos", F.when(F.col("step") == 1, F.lead("end_pos").over(same))
    )
    head = F.when(F.col("step") == 1, F.col("text"))
    name = F.regexp_extract(head, METHOD_HEADER, 2)
    before = F.split(F.trim(F.regexp_replace(F.regexp_extract(head, METHOD_HEADER, 1), r"\s+", " ")), " ")
    is_method = (
        F.lit(with_methods) & (F.col("step") == 1) & (name != "") & ~F.lower(name).isin(CONTROL)
        & ~F.lower(F.element_at(before, -1)).isin(CONTROL)
    )
    swept = swept.withColumn("is_method", is_method).withColumn("name", F.when(is_method, name)).withColumn("before", before)
    # a loop runs to the end of its block, or of its one statement; the head of a for may hold two semicolons
    order = Window.partitionBy(*KEY).orderBy("no")
    third = F.lead(F.struct("step", "close_no", "no"), 2).over(order)
    swept = swept.withColumn("third", third).withColumn("cut_head", (F.col("closer") == ";") & (_open_parentheses(F.col("text")) > 0))
    reach = (
        F.when(F.col("step") == 1, F.col("close_no")).when(F.col("cut_head") & (F.col("third.step") == 1), F.col("third.close_no"))
        .when(F.col("cut_head"), F.col("third.no")).otherwise(F.col("no"))
    )
    swept = swept.withColumn("loop_close", F.when(F.regexp_like("text", F.lit(LOOP)), reach))
    marked = scan(
        swept.drop("third", "cut_head"), KEY, "no",
        lasts={"around": F.when(F.col("is_method"), F.struct("no", "close_no", "name", "end_pos", "close_pos"))},
        peaks={"loop_end": F.col("loop_close")},
    )
    inside = (F.col("around.close_no") >= F.col("no"))
    return marked.withColumn("method", F.when(inside, F.col("around.name"))).withColumn(
        "in_loop", F.coalesce(F.col("loop_end") >= F.col("no"), F.lit(False))
    ).withColumn("method_at", F.when(inside, F.struct("around.end_pos", "around.close_pos"))).withColumn("method_no", F.when(inside, F.col("around.no")))


def holding(stmts: DataFrame, *patterns: str) -> DataFrame:
    """The statements that any of the patterns matches, with what ``queries``, ``dml``, ``field_writes`` and ``flags`` read of them.

    A job that reads statements in several ways writes these few rows once.
    """
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | F.col("text").rlike(pattern)
    return stmts.filter(hit).select(*KEY, "no", "text", "step", "start_line", "method", "in_loop", "end_pos", "close_pos")


def beside_code(rows: DataFrame, prep: DataFrame, *steps) -> DataFrame:
    """Rows with what ``steps`` read from the text of their class.

    A step takes a row (as a struct) and the text and returns columns by name.
    The rows of a class are bounded by its text; they meet it once, and the
    text itself goes no further.
    """
    names = [x for x in rows.columns if x not in KEY]
    held = rows.groupBy(*KEY).agg(F.collect_list(F.struct(*names)).alias("__rows"))

    def with_found(step):
        def extend(x: Column) -> Column:
            row = {n: x[n] for n in names}
            row |= step(row, F.col("code"))
            names[:] = row
            return F.struct(*[v.alias(n) for n, v in row.items()])

        return extend

    items = F.col("__rows")
    for step in steps:
        items = F.transform(items, with_found(step))
    return held.join(prep.select(*KEY, "code").hint("merge"), KEY).select(*KEY, F.inline(items))


def extract_by(text: Column | str, pattern: Column, group: int) -> Column:
    """regexp_extract with a pattern that differs per row."""
    return F.call_function("regexp_extract", F.col(text) if isinstance(text, str) else text, pattern, F.lit(group))


def ahead_of(text: str = "text") -> Column:
    """The statement up to the match that ``found`` told."""
    return F.substring(F.col(text), F.lit(1), F.col("at"))


def found(stmts: DataFrame, pattern: str, group_count: int = 0, column: str = "text") -> DataFrame:
    """One row per match, with the line it starts on."""
    hits = stmts.filter(F.col(column).rlike(pattern))
    # the outer form: the inner one makes Spark compute the matches a second time to filter on them
    rows = hits.select("*", F.posexplode_outer(c.matches(F.col(column), pattern)).alias("hit_no", "__hit"))
    rows = rows.withColumn("hit", F.col("__hit.value")).withColumn("at", F.col("__hit.start")).drop("__hit")
    ahead = ahead_of(column)
    rows = rows.withColumn("line", F.col("start_line") + F.length(ahead) - F.length(F.regexp_replace(ahead, "\n", "")))
    for i in range(1, group_count + 1):
        rows = rows.withColumn(f"g{i}", F.regexp_extract("hit", pattern, i))
    return rows


def components(prep: DataFrame) -> DataFrame:
    """Card envelope: kind, sharing, parent, interfaces, size, test flag."""
    code = F.col("code")
    kind = F.lower(F.regexp_extract(code, CLASS_DECL, 2))
    sharing = F.lower(F.regexp_extract(code, CLASS_DECL, 1))
    implements = F.regexp_extract(code, r"(?is)\bimplements\s+([\w.,\s<>]+?)\s*\{", 1)
    parent = F.regexp_extract(code, r"(?i)\bextends\s+([\w.]+)", 1)
    return prep.select(
        *KEY,
        F.when(kind == "class", "ApexClass").when(kind == "interface", "ApexInterface").when(kind == "enum", "ApexEnum").otherwise("ApexClass").alias("type"),
        F.when(kind == "", "not_specified").when(sharing == "", "inherited").otherwise(sharing).alias("sharing"),
        F.nullif(parent, F.lit("")).alias("extends"),
        F.array_join(F.filter(F.transform(F.split(implements, ","), lambda x: F.trim(x)), lambda x: x != ""), ";").alias("implements"),
        (F.length("raw_code") - F.length(F.regexp_replace("raw_code", "\n", "")) + 1).cast("bigint").alias("loc"),
        (F.lower(code).contains("@istest") | F.lower("component_id").endswith("test")).alias("is_test_class"),
    )


def triggers(prep: DataFrame) -> DataFrame:
    return prep.select(
        *KEY, F.nullif(F.regexp_extract("code", TRIGGER, 2), F.lit("")).alias("object"),
        F.array_join(F.transform(F.split(F.regexp_extract("code", TRIGGER, 3), ","), lambda x: F.trim(x)), ", ").alias("events"),
    )


def _marked(kind: str):
    return lambda name: F.struct(F.lit(kind).alias("kind"), F.concat(name, F.lit("()")).alias("detail"))


def entry_points(prep: DataFrame, stmts: DataFrame) -> DataFrame:
    """Job interfaces by class header (inner classes apart), REST, and annotated methods."""
    headers = found(stmts.filter("step = 1"), r"\bclass\s+(\w+)([^{;]*)\{", 2).filter(F.lower("g2").rlike(r"\bimplements\b"))
    after = F.regexp_extract("g2", r"(?is)\bimplements\b(.*)$", 1)
    jobs = F.array_compact(F.array(
        F.when(after.rlike(r"(?i)Database\.Batchable"), F.lit("Batchable")),
        F.when(after.rlike(r"(?i)\bQueueable\b"), F.lit("Queueable")),
        F.when(after.rlike(r"(?i)\bSchedulable\b"), F.lit("Schedulable")),
    ))
    inner = F.col("g1") != F.col("component_id")
    by_header = headers.select(*KEY, F.explode(jobs).alias("kind"), F.when(inner, F.col("g1")).alias("inner_class")).withColumn(
        "detail", F.concat(
            F.when(F.col("kind") == "Batchable", "Database.Batchable").otherwise(F.col("kind")),
            F.when(F.col("inner_class").isNotNull(), F.concat(F.lit(" (inner class "), "inner_class", F.lit(")"))).otherwise(""),
        )
    )
    code = F.col("code")
    shown = [F.transform(F.regexp_extract_all(code, F.lit(pattern), 1), _marked(kind)) for kind, pattern in MARKED_METHODS.items()]
    rest = F.transform(
        F.regexp_extract_all(code, F.lit(REST_RESOURCE), 1), lambda n: F.struct(F.lit("RestResource").alias("kind"), n.alias("detail"))
    )
    marked = prep.select(*KEY, F.inline_outer(F.concat(rest, *shown))).filter("kind IS NOT NULL").withColumn("inner_class", F.lit(None).cast("string"))
    return by_header.unionByName(marked)


def trigger_entry_points(prep: DataFrame) -> DataFrame:
    """A trigger is entered by the events of its object."""
    return triggers(prep).filter(F.col("object").isNotNull()).select(
        *KEY, F.lit("Trigger").alias("kind"), F.lit(None).cast("string").alias("inner_class"),
        F.concat("object", F.lit(" ("), "events", F.lit(")")).alias("detail"),
    )


def methods(prep: DataFrame, stmts: DataFrame) -> DataFrame:
    """Signature, lines and complexity; what a body holds is summed over its statements, its text is not copied."""
    heads = stmts.filter("is_method")
    words = F.transform("before", F.lower)
    is_ctor = F.col("name") == F.col("component_id")
    text = F.col("text")
    branches = (
        F.regexp_count(text, F.lit(r"\b(if|for|while|case|catch)\b")) + F.regexp_count(text, F.lit("&&"))
        + F.regexp_count(text, F.lit(r"\|\|")) + F.regexp_count(text, F.lit(r"\?"))
    )
    inside = stmts.filter((F.col("method_no") < F.col("no")) & ~F.col("is_method"))
    held = inside.groupBy(*KEY, F.col("method_no").alias("no")).agg(F.sum(branches).alias("branches"), F.sum("breaks").alias("body_lines"))
    rows = heads.join(held.hint("merge"), [*KEY, "no"], "left")
    complexity = F.lit(1) + F.coalesce("branches", F.lit(0))
    return rows.select(
        *KEY, "no", "name", F.concat("name", F.lit("("), F.trim(F.regexp_extract("text", METHOD_HEADER, 3)), F.lit(")")).alias("signature"),
        F.try_element_at(F.filter(words, lambda w: w.isin(VISIBILITIES)), F.lit(1)).alias("visibility"),
        F.array_contains(words, "static").alias("is_static"),
        F.when(~is_ctor, F.element_at("before", -1)).alias("returns"),
        F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"@(\w+)"), 1))), ",").alias("annotations"),
        F.coalesce("body_lines", F.lit(0)).cast("bigint").alias("loc"),
        complexity.cast("bigint").alias("complexity"),
    )


def queries(stmts: DataFrame) -> DataFrame:
    """Static queries with their clauses, and dynamic ones marked as such."""
    hits = found(stmts, QUERY)
    inner = F.trim(F.regexp_replace("hit", r"(?s)^\[|\]$", ""))
    hits = hits.withColumn("inner", inner)
    flat = F.regexp_replace("inner", r"(?is)\(\s*SELECT\b.*?\)", "")
    subs = F.regexp_extract_all("inner", F.lit(r"(?is)\(\s*SELECT\b.*?\bFROM\s+([A-Za-z0-9_]+).*?\)"), 1)
    listed = F.filter(F.transform(F.split(F.regexp_extract(flat, r"(?is)\bSELECT\b(.*?)\bFROM\b", 1), ","), lambda x: F.trim(x)), lambda f: f != "")
    where = F.trim(F.regexp_extract(flat, r"(?is)\bWHERE\b(.*?)(?:\bORDER\s+BY\b|\bLIMIT\b|\bGROUP\s+BY\b|$)", 1))
    ordered = F.trim(F.regexp_extract(flat, r"(?is)\bORDER\s+BY\s+(.*?)(?:\bLIMIT\b|$)", 1))
    limit = F.regexp_extract(flat, r"(?i)\bLIMIT\s+(\d+)", 1)
    static = hits.select(
        *KEY, "line", "method", "in_loop", F.lit(False).alias("is_dynamic"), c.query_object(flat).alias("object"),
        F.array_join(listed, ",").alias("fields"), F.when(where != "", where).alias("where_text"),
        F.nullif(ordered, F.lit("")).alias("order_by"), F.nullif(limit, F.lit("")).cast("bigint").alias("limit_rows"),
        flat.rlike(r"(?i)WITH\s+SECURITY_ENFORCED|WITH\s+USER_MODE").alias("enforces_fls"), F.array_join(subs, ",").alias("subqueries"),
    )
    dynamic = found(stmts, DYNAMIC_QUERY).select(*KEY, "line", "method", "in_loop", F.lit(True).alias("is_dynamic"))
    return static.unionByName(dynamic, allowMissingColumns=True)


def dml(stmts: DataFrame) -> DataFrame:
    direct = found(stmts, DML, 2).select(
        *KEY, "no", "line", "method", "in_loop", F.lower("g1").alias("op"),
        F.split(F.split("g2", r"\[")[0], r"\.")[0].alias("receiver"),
        (F.col("g2").endswith("]") | F.lower("g2").contains("list")).alias("is_bulk"), F.lit(None).cast("string").alias("via"),
    )
    calls = found(stmts, DML_CALL, 1).select(
        *KEY, "no", "line", "method", "in_loop", F.lower("g1").alias("op"), F.lit(None).cast("string").alias("receiver"),
        F.lit(True).alias("is_bulk"), F.concat(F.lit("Database."), F.lower("g1")).alias("via"),
    )
    return direct.unionByName(calls)


def catch_handlers(prep: DataFrame, stmts: DataFrame) -> DataFrame:
    """What each handler does with its exception, by a fixed precedence."""
    heads = found(stmts.filter("step = 1"), CATCH, 2).select(*KEY, "line", "method", F.col("g1").alias("type"), "g2", "end_pos", "close_pos")

    def body(x: dict, code: Column) -> dict:
        return {"body": F.substr(code, x["end_pos"] + 1, F.coalesce(x["close_pos"], F.length(code)) - x["end_pos"] - 1)}

    def told(x: dict, code: Column) -> dict:
        facts = {name: F.regexp_like(x["body"], F.lit(pattern)) for name, pattern in HANDLER_FACTS.items()}
        facts["rethrows"] = F.regexp_like(x["body"], F.concat(F.lit(r"\bthrow\b\s+"), x["g2"], F.lit(r"\b")))
        facts["statements"] = F.size(F.filter(F.split(x["body"], ";"), lambda s: F.regexp_replace(s, r"\s+", "") != "")).cast("bigint")
        return facts

    rows = beside_code(heads, prep, body, told)
    effect = (
        F.when(F.col("wraps_and_rethrows"), "wrap_rethrow").when(F.col("rethrows"), "rethrow").when(F.col("adds_error"), "add_error")
        .when(F.col("publishes_event"), "publishes_event").when(F.col("persists_log"), "persist_log")
        .when(F.col("debug_only") & (F.col("statements") > 0), "debug_only").when(F.col("statements") == 0, "empty").otherwise("swallow")
    )
    return rows.select(*KEY, "line", "method", "type", *HANDLER_FACTS, "rethrows", "statements", effect.alias("effect"))


def static_state(prep: DataFrame) -> DataFrame:
    """Static collections, and whether anything clears or replaces them; found in the text where it lies."""
    part = lambda x, i: F.regexp_extract(x, STATIC_COLLECTION, i)
    lines = F.filter(F.split("code", "\n"), lambda x: x.rlike(STATIC_COLLECTION))
    named = F.transform(lines, lambda x: F.struct(part(x, 3).alias("name"), (part(x, 1) != "").alias("is_final"), part(x, 2).alias("collection")))

    def state(x: Column) -> Column:
        renewed = F.regexp_count(F.col("code"), F.concat(F.lit(r"\b"), x["name"], F.lit(r"\s*=\s*new\b")))
        cleared = F.regexp_count(F.col("code"), F.concat(F.lit(r"\b"), x["name"], F.lit(r"\s*\.\s*clear\s*\(\s*\)")))
        return F.struct(x["name"].alias("name"), x["is_final"].alias("is_final"), x["collection"].alias("collection"), ((renewed > 1) | (cleared > 0)).alias("reset_elsewhere"))

    # the outer form, filtered after: a filter on the text, or the size filter of the inner form, goes below the spread of the sources
    rows = prep.withColumn("named", F.when(F.col("code").rlike(STATIC_COLLECTION), named))
    # of several lines with one name the first counts
    first = F.filter("named", lambda x, i: ~F.exists(F.slice("named", F.lit(1), i), lambda y: y["name"] == x["name"]))
    return rows.select(*KEY, F.inline_outer(F.transform(first, state))).filter("name IS NOT NULL")


def field_writes(prep: DataFrame, stmts: DataFrame) -> DataFrame:
    """Field assignments with risk (stale static caches) and its reason, and whether the value is committed."""
    hits = found(stmts, FIELD_WRITE, 3).withColumn("rhs", F.trim("g3"))
    source = F.nullif(F.regexp_extract("rhs", MAP_LOOKUP, 1), F.lit(""))
    pattern = F.when(source.isNotNull(), "map_lookup").when(F.col("rhs").rlike(r"^\s*new\s+"), "constructor").otherwise("direct")
    hits = hits.withColumn("source_map", source).withColumn("pattern", pattern)
    state = static_state(prep).select(*KEY, F.col("name").alias("source_map"), "reset_elsewhere")
    commits = dml(stmts).filter("receiver IS NOT NULL").select(*KEY, F.col("receiver").alias("g1"), F.coalesce("method", F.lit("")).alias("in_method"), "line")
    commits = commits.groupBy(*KEY, "g1", "in_method").agg(F.min("line").alias("persisted_by"))
    rows = hits.withColumn("in_method", F.coalesce("method", F.lit(""))).join(state.hint("merge"), [*KEY, "source_map"], "left").join(
        commits.hint("merge"), [*KEY, "g1", "in_method"], "left"
    )
    # where a receiver goes to is a fact of the class, found once for each receiver
    receivers = hits.select(*KEY, "g1").distinct()
    handed = beside_code(receivers, prep, lambda x, code: {"callee": extract_by(code, F.concat(F.lit(HANDED_TO[0]), x["g1"], F.lit(HANDED_TO[1])), 1)})
    rows = rows.join(handed.hint("merge"), [*KEY, "g1"], "left")
    passed = F.when(F.col("persisted_by").isNull() & (F.col("callee") != "") & ~F.col("callee").isin(*NO_CALLEES), F.col("callee"))
    risk = (
        F.when(F.col("pattern") != "map_lookup", "low").when(~F.coalesce("reset_elsewhere", F.lit(True)), "high").otherwise("medium")
    )
    reason = F.when(F.col("pattern") == "map_lookup", F.concat(
        F.lit("read from "), "source_map",
        F.when(F.col("reset_elsewhere").isNull(), ", not computed for this record")
        .when(F.col("reset_elsewhere"), ", a static collection; check that its reset covers this path")
        .otherwise(", a static collection that is never reset: a value of another record may remain"),
    ))
    value = F.when(F.col("pattern") == "direct", c.source_literal(F.col("rhs"))).otherwise("string")
    return rows.select(
        *KEY, "line", "method", F.col("g2").alias("field"), F.col("g1").alias("receiver"), "pattern", "source_map", risk.alias("risk"), reason.alias("reason"),
        value.alias("value_type"), F.col("rhs").alias("value"), "persisted_by", passed.alias("passed_to"),
        F.when(F.col("persisted_by").isNotNull(), "persisted").when(passed.isNotNull(), "passed_to_callee").otherwise("unpersisted_or_unresolved").alias("persistence"),
    )


def call_arguments(text: Column) -> Column:
    """Top-level argument texts of the call whose ``(`` starts ``text``; quotes and nesting respected.

    Works on the pieces between brackets, commas and quotes of one statement.
    """
    pieces = F.split(text, r"(?<=[()\[\]{},'])|(?=[()\[\]{},'])")
    zero = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("done"), F.lit("").alias("cur"),
        F.array().cast("array<string>").alias("args"),
    )

    def step(acc: Column, p: Column) -> Column:
        opening, closing = p.isin("(", "[", "{"), p.isin(")", "]", "}")
        live = ~acc["quoted"]
        depth = F.when(live & opening, acc["depth"] + 1).when(live & closing, acc["depth"] - 1).otherwise(acc["depth"])
        ends = live & closing & (acc["depth"] == 1)
        cut = live & (p == ",") & (acc["depth"] == 1)
        outer = live & opening & (acc["depth"] == 0)
        nxt = F.struct(
            depth.alias("depth"), F.when(p == "'", ~acc["quoted"]).otherwise(acc["quoted"]).alias("quoted"), ends.alias("done"),
            F.when(ends | cut | outer, "").otherwise(F.concat(acc["cur"], p)).alias("cur"),
            F.when(ends | cut, F.array_append(acc["args"], F.trim(acc["cur"]))).otherwise(acc["args"]).alias("args"),
        )
        return F.when(acc["done"], acc).otherwise(nxt)

    return F.filter(F.aggregate(pieces, zero, step)["args"], lambda a: a != "")


def async_dispatches(prep: DataFrame, stmts: DataFrame, names: DataFrame) -> DataFrame:
    """Where async work is started and, as far as the source tells, which class it runs."""
    rows = found(stmts, DISPATCH_CALL, 1).withColumn("mechanism", F.lower(F.regexp_replace("g1", r"\s", "")))
    rows = rows.withColumn("rest", F.substr(F.col("text"), F.col("at") + F.length("hit")))
    rows = rows.withColumn("args", call_arguments(F.col("rest")))

    def argument(position: dict[str, int]) -> Column:
        at = F.lit(None).cast("int")
        for mechanism, i in position.items():
            at = F.when(F.col("mechanism") == mechanism.lower(), i + 1).otherwise(at)
        return F.try_element_at("args", at)

    rows = rows.withColumn("job", argument({m: at for m, (at, _x) in DISPATCH.items()}))
    for key in ("delay_minutes", "scope_size", "job_name", "cron"):
        rows = rows.withColumn(key, argument({m: x[key] for m, (_at, x) in DISPATCH.items() if key in x}))
    proper = F.lit(None).cast("string")
    for m in DISPATCH:
        proper = F.when(F.col("mechanism") == m.lower(), m).otherwise(proper)
    expr = F.regexp_replace(F.trim("job"), r"^\(\s*[\w.<>]+\s*\)\s*", "")
    rows = rows.withColumn("mechanism", proper).withColumn("expr", expr).withColumn("ident", F.regexp_extract("expr", r"^(?:this\s*\.\s*)?([A-Za-z_]\w*)$", 1))
    told = ("delay_minutes", "scope_size", "job_name", "cron")
    rows = rows.select(*KEY, "mechanism", "line", "method", "in_loop", "expr", "ident", "method_at", F.col("component_id").alias("own"), *told)

    def scope(x: dict, code: Column) -> dict:
        at = x["method_at"]
        return {"scope": F.coalesce(F.substr(code, at["end_pos"], at["close_pos"] - at["end_pos"] + 1), code)}

    def resolve(x: dict, code: Column) -> dict:
        ident, job = x["ident"], x["expr"]

        def assigned(text: Column) -> Column:
            return extract_by(text, F.concat(F.lit(r"\b"), ident, F.lit(r"\s*=\s*new\s+([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)\s*\(")), 1)

        def declared(text: Column) -> Column:
            kinds = F.regexp_extract_all(text, F.concat(F.lit(r"\b([A-Za-z_][\w.]*)\s+"), ident, F.lit(r"\s*[=;,)]")), F.lit(1))
            fit = F.filter(kinds, lambda t: ~F.lower(t).isin(JOB_INTERFACES + CONTROL + NOT_TYPES))
            return F.coalesce(F.try_element_at(fit, F.lit(1)), F.lit(""))

        first_new = F.regexp_replace(F.regexp_extract(job, "^" + NEW, 0), r"(?s)^new\s+|\s*\($|\s", "")
        any_new = F.regexp_replace(F.regexp_extract(job, NEW, 0), r"(?s)^new\s+|\s*\($|\s", "")
        is_name = (ident != "") & (job != "this")
        steps = [
            (first_new != "", first_new, "constructor"), (job == "this", x["own"], "this"),
            (is_name & (assigned(x["scope"]) != ""), assigned(x["scope"]), "variable_assignment"),
            (is_name & (assigned(code) != ""), assigned(code), "variable_assignment"),
            (is_name & (declared(x["scope"]) != ""), declared(x["scope"]), "declared_type"),
            (is_name & (declared(code) != ""), declared(code), "declared_type"),
            (~is_name & (any_new != ""), any_new, "constructor_in_expression"),
        ]
        found_as = F.lit(None).cast("struct<target:string,how:string>")
        for cond, value, name in reversed(steps):
            found_as = F.when(cond, F.struct(value.alias("target"), F.lit(name).alias("how"))).otherwise(found_as)
        literal = {}
        for key in told:
            number = extract_by(x["scope"], F.concat(F.lit(r"\b"), F.coalesce(F.when(x[key].rlike(r"^[A-Za-z_]\w*$"), x[key]), F.lit("(none)")), F.lit(r"\s*=\s*(\d+)\s*;")), 1)
            literal[f"{key}_value"] = F.when(x[key].rlike(r"^'[^']*'$"), F.regexp_replace(x[key], "^'|'$", "")).when(number != "", number).otherwise(x[key])
        return {"found_as": found_as, **literal}

    def inner(x: dict, code: Column) -> dict:
        resolved = x["found_as"]["target"]
        return {
            "resolved": resolved, "resolution": F.coalesce(x["found_as"]["how"], F.lit("unresolved")),
            "declares_it": F.regexp_like(code, F.concat(F.lit(r"\bclass\s+"), F.coalesce(resolved, F.lit("(none)")), F.lit(r"\b"))),
        }

    rows = beside_code(rows, prep, scope, resolve, inner)
    known = names.select(F.col("org_id").alias("n_org"), F.col("name").alias("n_name"))
    outer = F.split("resolved", r"\.")[0]
    rows = rows.withColumn("outer", outer).join(known.hint("merge"), (F.col("org_id") == F.col("n_org")) & (F.col("outer") == F.col("n_name")), "left")
    is_known = F.col("n_name").isNotNull() | (F.col("outer") == F.col("component_id"))
    dotted = F.col("resolved").contains(".")
    is_inner = ~dotted & ~is_known & F.col("declares_it")
    return rows.select(
        *KEY, "mechanism", "line", "method", "in_loop", "resolution",
        F.when(is_inner, F.col("component_id")).when(dotted & F.col("n_name").isNotNull(), F.col("outer")).otherwise(F.col("resolved")).alias("target"),
        F.when(is_inner, F.col("resolved")).when(dotted, F.substring_index("resolved", ".", -1)).alias("inner_class"),
        F.coalesce(is_inner | (F.when(dotted, F.col("n_name").isNotNull()).otherwise(is_known)), F.lit(False)).alias("target_in_kb"),
        *[F.col(f"{k}_value").alias(k) for k in told],
    )


def _named(rows: DataFrame, names: DataFrame, text: str, prefix: str) -> DataFrame:
    """Joins the declared spelling of a class name written in any case."""
    known = names.select(
        F.col("org_id").alias(f"{prefix}_org"), F.lower("name").alias(f"{prefix}_low"), F.col("name").alias(f"{prefix}_name")
    )
    return rows.join(known.hint("merge"), (F.col("org_id") == F.col(f"{prefix}_org")) & (F.lower(F.col(text)) == F.col(f"{prefix}_low")), "left").drop(f"{prefix}_org", f"{prefix}_low")


def qualified_calls(stmts: DataFrame, names: DataFrame) -> DataFrame:
    """Calls with a receiver: the class meant, its namespace where one is written, and the method."""
    hits = found(stmts, CALL, 2).withColumn("chain", F.regexp_replace("g1", r"\.$", "")).withColumn("segs", F.split("chain", r"\."))
    hits = hits.withColumn("head", F.col("segs")[0]).withColumn("second", F.try_element_at("segs", F.lit(2)))
    rows = _named(_named(hits, names, "head", "h"), names, "second", "s")
    capital = F.col("head").rlike("^[A-Z]")
    could_be_ns = F.col("h_name").isNull() & capital & ~F.col("head").isin(SYSTEM_CLASSES + NAMESPACES) & ~F.col("head").rlike("__(c|r|e|mdt)$")
    guessed = F.col("head").contains("_") & F.col("second").rlike("^[A-Z]")
    has_ns = could_be_ns & F.col("second").isNotNull() & (F.col("s_name").isNotNull() | guessed)
    ahead = ahead_of()
    return rows.withColumn("namespace", F.when(has_ns, F.col("head"))).withColumn(
        "ns_class", F.when(has_ns, F.coalesce("s_name", "second"))
    ).withColumn("is_new", ahead.rlike(r"\bnew\s*$")).withColumn("callee", F.concat_ws(".", "chain", "g2"))


def calls_to(stmts: DataFrame, names: DataFrame, dispatches: DataFrame) -> DataFrame:
    """Class-level edges: (component, target, via, method), noise receivers dropped."""
    last = F.element_at("segs", -1)
    calls = qualified_calls(stmts, names).withColumn("receiver", last)
    calls = _named(calls, names, "receiver", "r")
    spelled = F.when(F.col("receiver").rlike("^[A-Z]"), F.coalesce("r_name", "receiver")).otherwise(F.col("receiver"))
    calls = calls.withColumn("target", spelled).filter((F.col("target") != F.col("component_id")) & F.col("target").rlike("^[A-Z]"))
    called = calls.select(*KEY, "target", F.lit("method_call").alias("via"), F.col("g2").alias("method"), F.col("r_name").isNotNull().alias("known"), "namespace")
    made = found(stmts, NEW, 1)
    made = _named(made, names, "g1", "n").filter((F.col("n_name") == F.col("g1")) & (F.col("g1") != F.col("component_id"))).select(
        *KEY, F.col("g1").alias("target"), F.lit("constructor").alias("via"), F.lit(None).cast("string").alias("method"), F.lit(True).alias("known"), F.lit(None).cast("string").alias("namespace")
    )
    # of a dotted name the first part that is a class
    named = found(stmts, FOR_NAME, 1).select(*KEY, "no", "at", F.posexplode(F.split("g1", r"\.")).alias("part_no", "part"))
    named = _named(named, names, "part", "n").filter((F.col("n_name") == F.col("part")) & (F.col("part") != F.col("component_id")))
    reflected = named.groupBy(*KEY, "no", "at").agg(F.min_by("part", "part_no").alias("target")).select(
        *KEY, "target", F.lit("Type.forName").alias("via"), F.lit(None).cast("string").alias("method"), F.lit(True).alias("known"), F.lit(None).cast("string").alias("namespace")
    )
    started = dispatches.filter("target_in_kb AND target <> component_id").select(
        *KEY, "target", F.col("mechanism").alias("via"), F.lit(None).cast("string").alias("method"), F.lit(True).alias("known"), F.lit(None).cast("string").alias("namespace")
    )
    edges = called.unionByName(made).unionByName(reflected).unionByName(started)
    # the ways and methods of one class calling another are bounded by its own text
    grouped = edges.groupBy(*KEY, "target").agg(
        F.bool_or("known").alias("known"), F.array_sort(F.collect_set("via")).alias("vias"),
        F.array_sort(F.collect_set("method")).alias("methods"), F.max("namespace").alias("namespace"),
    )
    noise = F.col("target").isin(SYSTEM_CLASSES) | F.col("target").rlike("__(c|r)$") | (
        F.forall("methods", lambda m: F.lower(m).isin(COLLECTION_METHODS))
    )
    return grouped.filter(F.col("known") | ~noise).select(
        *KEY, "target", F.when(F.col("namespace").isNotNull(), "namespaced_class").when(F.col("known"), "local_class").otherwise("unresolved_receiver").alias("kind"),
        F.array_join("vias", ",").alias("via"), F.array_join("methods", ",").alias("methods_called"), "namespace",
    )


def _inline_end(text: Column) -> Column:
    """Length of the head of a branch without braces: up to the parenthesis that closes its condition, however deep that nests.

    Null where the text is no such branch, or where no statement follows the head.
    """
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(acc: Column, p: Column) -> Column:
        depth = F.when(p == "(", acc["depth"] + 1).when(p == ")", acc["depth"] - 1).otherwise(acc["depth"])
        pos = acc["pos"] + F.length(p)
        ends = (acc["end"] == 0) & (p == ")") & (depth == 0)
        return F.struct(pos.alias("pos"), depth.alias("depth"), F.when(ends, pos).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(F.regexp_extract_all(text, F.lit(BRACKETS), 0), start, step)["end"]
    return F.when(text.rlike(INLINE_HEAD), F.when((end > 0) & F.substr(text, end + 1).rlike(r"^\s*[^\s{;]"), end))


def guards(stmts: DataFrame) -> DataFrame:
    """Blocks that run under a condition, with the text of it and what earlier branches ruled out."""
    opened = stmts.filter("step = 1").withColumn("head", c.squeeze(F.regexp_replace("text", r"\{$", "")))
    head = F.col("head")
    kw = F.regexp_extract(head, r"\b(else if|if|for|while|catch)\s*\(", 1)
    cond = F.regexp_extract(head, r"\b(?:else if|if|for|while|catch)\s*\((.*)\)$", 1)
    word = F.when(kw != "", kw).when(head.rlike(r"\belse$"), "else").when(head.rlike(r"\btry$"), "try")
    blocks = opened.withColumn("word", word).withColumn("cond", cond).filter(F.col("word").isNotNull())
    # a for with semicolons is cut into three statements, the first of which holds the word
    order = Window.partitionBy(*KEY).orderBy("no")
    starts = (F.col("closer") == ";") & F.col("loop_close").isNotNull() & F.col("text").rlike(r"\bfor\s*\(")
    near = stmts.select(*KEY, "no", "depth", "loop_close", "closer", "text", F.coalesce(starts, F.lit(False)).alias("starts"))
    near = near.withColumn("second", F.lag("starts", 1, False).over(order)).withColumn("third", F.lag("starts", 2, False).over(order))
    near = near.filter("starts OR second OR third").withColumn("t2", F.lead("text", 1).over(order)).withColumn("t3", F.lead("text", 2).over(order))
    start = F.regexp_extract("text", r"(?s)\bfor\s*\((.*)$", 1)
    # the third part ends at the block's parenthesis, or, without braces, at the first that nothing in it opens
    braced, bare = F.regexp_extract("t3", r"(?s)^(.*)\)\s*\{$", 1), F.regexp_extract("t3", r"(?s)^([^()]*+(?:\([^()]*+\)[^()]*+)*+)\)", 1)
    whole = c.squeeze(F.concat(start, "t2", F.when(F.col("t3").endswith("{"), braced).otherwise(bare)))
    cut_head = F.col("starts") & (start != "") & _inline_end(F.col("text")).isNull()
    classic = near.filter(cut_head).select(
        *KEY, "no", F.col("loop_close").alias("close_no"), F.col("depth").alias("level"), F.lit("for").alias("word"), whole.alias("cond")
    )
    block = blocks.select(*KEY, "no", "close_no", "level", "word", "cond").unionByName(classic)
    branch = (F.col("closer") == ";") & F.col("text").rlike(r"^\s*(?:else|if|for|while)\b")
    is_else = F.col("text").rlike(INLINE_ELSE)
    branches = stmts.filter(branch).select(*KEY, "no", "depth", "text", _inline_end(F.col("text")).alias("inline_end"))
    single = branches.filter(F.col("inline_end").isNotNull() | is_else)
    whole_head = F.substring(F.col("text"), F.lit(1), F.col("inline_end"))
    space = F.length("text") - F.col("inline_end") - F.length(F.ltrim(F.regexp_replace(F.substr(F.col("text"), F.col("inline_end") + 1), r"^\s+", "")))
    condition = F.regexp_replace(F.regexp_replace(whole_head, INLINE_HEAD, ""), r"\)$", "")
    inline = single.select(
        *KEY, "no", F.col("no").alias("close_no"), F.col("depth").alias("level"),
        F.when(is_else, "else").otherwise(F.regexp_replace(F.regexp_extract("text", INLINE_HEAD, 1), r"\s+", " ")).alias("word"),
        F.when(is_else, "").otherwise(c.squeeze(condition)).alias("cond"),
        F.when(is_else, F.length(F.regexp_extract("text", INLINE_ELSE, 0))).otherwise(F.col("inline_end") + space).cast("int").alias("after"),
    )
    return block.withColumn("after", F.lit(None).cast("int")).unionByName(inline)


def labelled_guards(stmts: DataFrame) -> DataFrame:
    g = guards(stmts)
    order = Window.partitionBy(*KEY, "level").orderBy("no")
    fresh = (~F.col("word").isin("else", "else if")).cast("int")
    chained = g.withColumn("chain", F.sum(fresh).over(order))
    earlier = Window.partitionBy(*KEY, "level", "chain").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    ruled = F.collect_list(F.when(F.col("word").isin("if", "else if"), F.col("cond"))).over(earlier)
    out = chained.withColumn("ruled", F.array_join(ruled, " / "))
    label = (
        F.when(F.col("word") == "try", "try").when(F.col("word") == "else", F.concat(F.lit("else [not: "), "ruled", F.lit("]")))
        .when(F.col("word") == "else if", F.concat(F.lit("else if ("), "cond", F.lit(") [and not: "), "ruled", F.lit("]")))
        .otherwise(F.concat("word", F.lit(" ("), "cond", F.lit(")")))
    )
    return out.select(*KEY, "no", "close_no", "after", label.alias("label"))


def innermost(stmts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, no, block_no): the block (no, close_no) around each statement, of nested ones the last; null outside all.

    Blocks nest, so the one around a statement is the last one opened at the
    level below the statement's own.  Level and last opening are running values
    over the source: no statement meets the blocks of its class one by one.
    """
    what = lambda df, no, opens, closes: df.select(*KEY, F.col(no).alias("no"), F.lit(opens).alias("opens"), F.lit(closes).alias("closes"))
    marks = what(stmts, "no", 0, 0).unionByName(what(blocks, "no", 1, 0)).unionByName(what(blocks, "close_no", 0, 1))
    earlier = Window.partitionBy(*KEY).orderBy("no").rangeBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum(F.col("opens") - F.col("closes")).over(earlier), F.lit(0))
    placed = marks.withColumn("level", level).filter("closes = 0").withColumn("level", F.col("level") - 1 + F.col("opens"))
    last = Window.partitionBy(*KEY, "level").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.last(F.when(F.col("opens") == 1, F.col("no")), ignorenulls=True).over(last)
    return placed.withColumn("block_no", opened).filter("opens = 0").select(*KEY, "no", "block_no")


def condition_paths(labelled: DataFrame, inside: DataFrame) -> DataFrame:
    """(key, no, after, path): every guard's condition behind those of the blocks around it, outermost first.

    ``inside`` tells the block around each statement.  Each round hangs a
    guard's path onto that of the block it points to and points it to where that
    one points: rounds grow with the logarithm of the nesting.
    """
    ways = labelled.join(inside.hint("merge"), [*KEY, "no"]).select(*KEY, "no", "after", F.col("label").alias("path"), F.col("block_no").alias("up"))
    ways = written(ways, "condition-paths")
    while not ways.filter("up IS NOT NULL").isEmpty():
        above = ways.select(*KEY, F.col("no").alias("up"), F.col("path").alias("upper"), F.col("up").alias("beyond"))
        longer = F.concat_ws(" > ", "upper", "path")
        ways = written(ways.join(above.hint("merge"), [*KEY, "up"], "left").select(*KEY, "no", "after", longer.alias("path"), F.col("beyond").alias("up")), "condition-paths")
    return ways.drop("up")


def call_sites(stmts: DataFrame, names: DataFrame) -> DataFrame:
    """Every call in source order with its method, line and enclosing conditions."""
    own = stmts.filter("is_method").select(*KEY, F.col("name").alias("own_name")).distinct()
    calls = qualified_calls(stmts, names)
    calls = calls.join(own.withColumnRenamed("own_name", "g2").withColumn("own", F.lit(True)).hint("merge"), [*KEY, "g2"], "left")
    head = F.when(F.col("head").rlike("^[A-Z]"), F.coalesce("h_name", "head")).otherwise(F.col("head"))
    is_own = F.coalesce("own", F.lit(False))
    kind = (
        F.when(F.col("chain") == "this", F.when(is_own, "same_class"))
        .when(F.col("namespace").isNotNull(), F.when(F.col("is_new"), "constructor").otherwise("namespaced_class"))
        .when(head == F.col("component_id"), F.when(is_own, "same_class"))
        .when(F.col("h_name") == head, F.when(F.col("is_new"), "constructor").otherwise("org_class"))
    )
    target = F.when(F.col("namespace").isNotNull(), F.col("ns_class")).when(F.col("chain") == "this", F.col("component_id")).otherwise(head)
    qualified = calls.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        *KEY, "no", "at", "line", "method", "in_loop", "kind", target.alias("target"), "namespace", F.col("g2").alias("method_called"), "callee"
    )
    bare = found(stmts, BARE_CALL, 1).join(own.withColumnRenamed("own_name", "g1").hint("merge"), [*KEY, "g1"]).filter(
        (F.col("g1") != F.col("component_id")) & ~F.col("is_method")
    )
    ahead = F.rtrim(F.regexp_replace(ahead_of(), r"\s+$", ""))
    word = F.lower(F.regexp_extract(ahead, r"([\w>\]]+)$", 1))
    bare = bare.filter((word == "") | word.isin(BEFORE_CALL)).select(
        *KEY, "no", "at", "line", "method", "in_loop", F.lit("same_class").alias("kind"), F.col("component_id").alias("target"),
        F.lit(None).cast("string").alias("namespace"), F.col("g1").alias("method_called"), F.concat_ws(".", "component_id", "g1").alias("callee"),
    )
    sites = qualified.unionByName(bare)
    guard = written(labelled_guards(stmts), "guards")
    inside = written(innermost(stmts, guard.filter("after IS NULL")), "guard-of-statement")
    paths = condition_paths(guard, inside)
    # a branch without braces holds what stands behind its condition; else the block around the statement counts
    same_line = paths.filter("after IS NOT NULL").select(*KEY, "no", "after", F.col("path").alias("own_path"))
    block = paths.filter("after IS NULL").select(*KEY, F.col("no").alias("block_no"), "path")
    placed = sites.join(inside.hint("merge"), [*KEY, "no"]).join(block.hint("merge"), [*KEY, "block_no"], "left").join(same_line.hint("merge"), [*KEY, "no"], "left")
    conditions = F.coalesce(F.when(F.col("at") >= F.col("after"), F.col("own_path")), "path", F.lit(""))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("no", "at", "callee"))
    return placed.withColumn("position", place).select(
        *KEY, "position", "line", "method", "in_loop", "kind", "target", "namespace", "method_called", "callee", conditions.alias("conditions"),
    )


def facts(prep: DataFrame) -> DataFrame:
    """Presence and names: callouts, credentials, exceptions thrown and defined."""
    def names(pattern: str, group: int) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("code", F.lit(pattern), group))), ",")

    return prep.select(
        *KEY, F.col("code").rlike(CALLOUT).alias("has_callout"), names(CREDENTIAL, 1).alias("credentials"),
        names(THROWN, 1).alias("exceptions_thrown"), names(CUSTOM_EXCEPTION, 1).alias("exceptions_defined"),
    )


def objects_referenced(prep: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Custom names and standard objects in a source; custom ones only if the org has them."""
    custom = F.regexp_extract_all("code", F.lit(CUSTOM_OBJECT), 0)
    standard = F.regexp_extract_all("code", F.lit(r"\b(" + "|".join(sorted(STANDARD_OBJECTS, key=len, reverse=True)) + r")\b"), 1)
    out = prep.select(*KEY, F.explode_outer(F.array_distinct(F.concat(custom, standard))).alias("object")).filter("object IS NOT NULL")
    if known is None:
        return out
    fixed = out.filter(F.col("object").isin(STANDARD_OBJECTS))
    return fixed.unionByName(out.filter(~F.col("object").isin(STANDARD_OBJECTS)).join(known.select("object"), "object", "left_semi").select(*KEY, "object"))


def flags(prep: DataFrame, stmts: DataFrame) -> DataFrame:
    """Derived flags as (component, flag) rows; the statement-level ones come from one pass."""
    text, loop = F.col("text"), F.col("in_loop")
    static = text.rlike(QUERY)
    dynamic = text.rlike(DYNAMIC_QUERY)
    open_query = static & ~text.rlike(r"(?i)WITH\s+SECURITY_ENFORCED|WITH\s+USER_MODE")
    seen = stmts.groupBy(*KEY).agg(
        F.bool_or(loop & (text.rlike(DML) | text.rlike(DML_CALL))).alias("dml_in_loop"),
        F.bool_or(loop & (static | dynamic)).alias("soql_in_loop"), F.bool_or(dynamic).alias("dynamic_soql"),
        F.bool_or(loop & text.rlike(DISPATCH_CALL)).alias("async_dispatch_in_loop"), F.bool_or(open_query).alias("open_query"),
    )
    controller = prep.filter(F.col("code").rlike(r"@(?:AuraEnabled|RemoteAction)\b|(?i:@RestResource)\s*\(")).select(*KEY).withColumn(
        "controller", F.lit(True)
    )
    seen = seen.join(controller.hint("merge"), KEY, "left").withColumn("no_fls_enforcement", F.col("open_query") & F.coalesce("controller", F.lit(False)))
    names = ("dml_in_loop", "soql_in_loop", "dynamic_soql", "async_dispatch_in_loop", "no_fls_enforcement")
    by_statement = seen.select(*KEY, F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))).alias("flag"))
    silent = catch_handlers(prep, stmts).filter(F.col("effect").isin("empty", "swallow", "debug_only")).select(
        *KEY, F.lit("silent_exception_handler").alias("flag")
    ).distinct()
    foreign = c.field_namespace(F.col("field")).isNotNull()
    by_write = field_writes(prep, stmts).select(*KEY, F.explode(F.array_compact(F.array(
        F.when(F.col("persistence") == "unpersisted_or_unresolved", F.lit("unpersisted_field_write")),
        F.when(foreign, F.lit("writes_managed_package_fields")),
    ))).alias("flag")).distinct()
    return by_statement.unionByName(silent).unionByName(by_write)


def extract_errors(sources: DataFrame) -> DataFrame:
    """Sources that cannot be read: one warning row each instead of a failed job."""
    code = stripped(F.col("code"))
    reason = (
        F.when(F.coalesce(F.trim("code"), F.lit("")) == "", "empty source")
        .when(F.regexp_count(code, F.lit(r"\{")) != F.regexp_count(code, F.lit(r"\}")), "unbalanced braces")
    )
    return sources.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*KEY, "reason")


# ---- UI bundles -------------------------------------------------------------


def decoded_files(files: DataFrame) -> DataFrame:
    """Bundle files by name, base64 undone where it is base64."""
    text = F.col("source")
    plain = F.decode(F.try_to_binary(text, F.lit("base64")), "UTF-8")
    looks = text.rlike(r"^[A-Za-z0-9+/\r\n]+={0,2}$") & (F.length(F.regexp_replace(text, r"\s", "")) % 4 == 0)
    return files.withColumn("content", F.when(looks, F.coalesce(plain, text)).otherwise(text)).withColumn(
        "file", F.substring_index("file_path", "/", -1)
    ).withColumn("bundle", F.element_at(F.split("file_path", "/"), -2))


def ui_bundles(files: DataFrame) -> DataFrame:
    """Per bundle: imported class methods, wire adapters, child tags, exposure and targets."""
    js = F.col("file") == F.concat("bundle", F.lit(".js"))
    html = F.col("file") == F.concat("bundle", F.lit(".html"))
    meta = F.col("file").endswith(".js-meta.xml")

    def names(cond: Column, pattern: str, group: int = 1) -> Column:
        return F.when(cond, F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), group))), ","))

    rows = files.select(
        "bundle",
        names(js, r"import\s+\w+\s+from\s+['\"]@salesforce/apex/([\w.]+)['\"]").alias("imports"),
        names(js, r"@wire\s*\(\s*([\w.]+)").alias("wires"),
        names(html, r"<([a-z][a-z0-9]*-[a-z0-9-]+)\b").alias("children"),
        F.when(meta, F.lower(F.trim(F.regexp_extract("content", r"<isExposed>([^<]*)</isExposed>", 1))) == "true").alias("is_exposed"),
        F.when(meta, F.array_join(F.regexp_extract_all("content", F.lit(r"<target>([^<]*)</target>"), 1), ",")).alias("targets"),
    )
    return rows.groupBy("bundle").agg(*[F.max(x).alias(x) for x in ("imports", "wires", "children", "is_exposed", "targets")])

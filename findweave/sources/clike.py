"""Symbols, includes and calls of C and C++ sources without a parser library.

Texts become rows of tokens; lines, offsets and nesting are running sums over a file's tokens, so
braces in strings and comments don't count. Tokens up to the next brace or semicolon form a segment,
whose words tell what it declares; an opening brace meets the next brace of its own level.

A file (of at most ``repository.MAX_BYTES``) is one window; files are spread by path and shuffled once.

Not seen: members set by braces in a constructor's list, old-style heads, code that macros make.
A file whose braces or parentheses don't match gives an entry ``error`` beside what was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findweave.session import materialize

#: Comments, raw and plain strings, characters, directives, numbers, names with their scopes, blanks, single signs.
TOKEN = "|".join((
    r"/\*[\s\S]*?(?:\*/|\z)", r"//(?:[^\n\\]++|\\[\s\S])*+", r'R"([^()\\\s"]{0,16})\([\s\S]*?\)\1"', r'"(?:[^"\\\n]++|\\[\s\S])*+"?', r"[0-9][\w.']*+",
    r"'(?:[^'\\\n]++|\\[\s\S])*+'?", r"(?m:^)[ \t]*+#(?:[^\n\\/]++|\\[\s\S]|/(?![*/]))*+", r"(?:::)?~?[A-Za-z_]\w*+(?:::~?[A-Za-z_]\w*+)*+", r"[^\S\n]*+\n|[^\S\n]++", r"[\s\S]",
))
ACCESS = ("public", "private", "protected", "signals", "slots")
#: Words that stand before a parenthesis without being called, and those after which a name is a call, not a declaration.
NOT_CALLED = ("if", "for", "while", "switch", "return", "sizeof", "alignof", "alignas", "decltype", "catch", "defined", "throw", "new", "delete", "noexcept", "static_assert", "_Static_assert", "__attribute__", "operator", "case", "else", "do")
BEFORE_CALLS = ("return", "else", "do", "case", "throw", "co_return", "co_await", "co_yield", "and", "or", "not", "goto")
_STATEMENT = r"(?!(?:if|for|while|switch|do|else|return|catch|namespace|using|typedef|try|case|goto|throw|delete)\b)"
_NAMESPACE = r"^(?:inline )?namespace(?: ([\w:]+))?$"
_TAG = r"^(typedef )?(?:(?:static|const|volatile|extern) )*(class|struct|union|enum)(?: class| struct)?(?: ([A-Za-z_]\w*))?(?: final)?(?: : .*)?$"
_FORWARD = r"^(class|struct|union|enum)(?: class)? ([A-Za-z_]\w*)$"
_FUNCTION = "^" + _STATEMENT + r"([^=(]*? )??(operator(?: [^\w\s(]++)++|operator \( \)|(?:::)?~?[A-Za-z_][\w:~]*) \("
_ALIAS = r"^typedef [^()]*?([A-Za-z_]\w*)(?: \[.*\])?$"
_VARIABLE = "^" + _STATEMENT + r"(?:[A-Za-z_]\w*+ (?:\* )*+(?=[A-Za-z_]))++([A-Za-z_]\w*+)(?: [=,\[].*)?$"
_INCLUDE = r'^\s*#\s*include\s*(?:"([^"]+)"|<([^>]+)>)'
_MACRO = r"^\s*#\s*define\s+([A-Za-z_]\w*)(?!\w|\()"

#: What each entry (symbol, import, call, error) has; as for Python, with signature and visibility.
COLUMNS = ("relative_path", "entry", "name", "qualified_name", "kind", "parent", "start_line", "end_line", "target", "content_hash", "signature", "visibility")


#: What is kept of a segment.
SEGMENT = (
    "relative_path", "language", "segment", "head", "calls", "at", "line", "end", "end_line", "end_at", "head_at", "directive", "parens", "braces", "least", "last", "close", "close_line", "close_at",
    "what", "local", "keyword", "typedef",
)


def _tokens(files: DataFrame) -> DataFrame:
    """Significant tokens with line, offset, brace level, segment and neighbours."""
    c, here = F.col, Window.partitionBy("relative_path").orderBy("pos")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    t = files.select("relative_path", "language", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    lines = F.length("tok") - F.length(F.replace("tok", F.lit("\n"), F.lit("")))
    step = F.when(c("tok") == "{", 1).when(c("tok") == "}", -1).otherwise(0)
    t = t.withColumns({"at": F.sum(F.length("tok")).over(upto) - F.length("tok"), "line": F.sum(lines).over(upto) - lines + 1, "depth": F.sum(step).over(upto)})
    t = t.where(~c("tok").rlike(r"^(?:\s+$|/[/*])"))
    directive = c("tok").rlike(r"^[ \t]*#")
    t = t.withColumns({
        "before": F.lag("tok").over(here), "after": F.lead("tok").over(here), "directive": directive, "level": F.when(c("tok") == "{", c("depth")).when(c("tok") == "}", c("depth") + 1),
    })
    label = (c("tok") == ":") & c("before").isin(*ACCESS)
    ends = c("tok").isin("{", "}", ";") | directive | label
    return t.withColumn("ends", ends).withColumn("segment", F.sum(ends.cast("int")).over(upto) - ends.cast("int"))


def _segments(tokens: DataFrame) -> DataFrame:
    """One row per run of tokens up to a brace, semicolon, directive or access label."""
    c = F.col
    word = F.when(c("tok").rlike(r'^R?"'), F.lit('""')).when(c("tok").startswith("'"), F.lit("''")).otherwise(c("tok"))
    declared = c("before").rlike(r"^[\w:]+$") & ~c("before").isin(*BEFORE_CALLS) & ~c("before").rlike(r"^\d")
    called = c("tok").rlike(r"^(?:::)?~?[A-Za-z_]") & (c("after") == "(") & ~c("tok").isin(*NOT_CALLED) & ~F.coalesce(declared, F.lit(False))
    return tokens.groupBy("relative_path", "language", "segment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~c("ends"), F.struct("pos", word.alias("word"))))), lambda x: x["word"]), " ").alias("head"),
        F.array_sort(F.collect_list(F.when(called, F.struct("pos", F.element_at(F.split("tok", "::"), -1).alias("name"), "line")))).alias("calls"),
        F.min("at").alias("at"), F.min("line").alias("line"), F.max_by("tok", "pos").alias("end"), F.max_by("level", "pos").alias("level"), F.max_by("line", "pos").alias("end_line"),
        F.max(c("at") + F.length("tok")).alias("end_at"), F.max(F.when(~c("ends"), c("at") + F.length("tok"))).alias("head_at"), F.bool_or("directive").alias("directive"),
        (F.count_if(c("tok") == "(") - F.count_if(c("tok") == ")")).alias("parens"), (F.count_if(c("tok") == "{") - F.count_if(c("tok") == "}")).alias("braces"), F.min("depth").alias("least"),
    )


def _classified(segments: DataFrame) -> DataFrame:
    """Segments with what they declare (``what``, ``local``) and where their block closes."""
    c, level, file = F.col, Window.partitionBy("relative_path", "level").orderBy("segment"), Window.partitionBy("relative_path")
    totals = {"parens": F.sum("parens").over(file), "braces": F.sum("braces").over(file), "least": F.min("least").over(file), "last": c("segment") == F.max("segment").over(file)}
    segments = segments.withColumns(totals)
    plain = F.regexp_replace("head", r"^template < [^()]*?> (?=[A-Za-z_])|__attribute__ \( \( .*? \) \) ?|__declspec \( \w+ \) ?|\[ \[ .*? \] \] ?", "")
    s = segments.withColumn("plain", F.trim(plain))
    opens, ended = c("end") == "{", c("end") == ";"
    closed = opens & (F.lead("end").over(level) == "}")
    s = s.withColumns({name: F.when(closed, F.lead(of).over(level)) for name, of in (("close", "segment"), ("close_line", "end_line"), ("close_at", "end_at"))})
    part = lambda pattern, n: F.nullif(F.regexp_extract("plain", pattern, n), F.lit(""))
    typed = part(_FUNCTION, 1).isNotNull()
    what = (
        F.when(c("directive"), F.lit("directive")).when(opens & c("plain").rlike(_NAMESPACE), F.lit("namespace")).when(opens & (c("plain") == 'extern ""'), F.lit("linkage"))
        .when(opens & c("plain").rlike(_TAG), F.when(part(_TAG, 3).isNull(), F.lit("nameless")).otherwise(F.lit("tag"))).when(ended & c("plain").rlike(_FORWARD), F.lit("forward"))
        .when(opens & c("plain").rlike(_FUNCTION), F.lit("function")).when(ended & c("plain").rlike(_ALIAS), F.lit("alias")).when(ended & c("plain").rlike(_FUNCTION), F.when(typed, F.lit("declared")).otherwise(F.lit("untyped")))
        .when((ended | opens) & c("plain").rlike(_VARIABLE), F.lit("variable"))
    )
    s = s.withColumn("what", what)
    function = F.regexp_replace(part(_FUNCTION, 2), r"(?<=\W)\s+|\s+(?=\W)", "")
    local = (
        F.when(c("what") == "namespace", part(_NAMESPACE, 1)).when(c("what") == "tag", part(_TAG, 3)).when(c("what") == "forward", part(_FORWARD, 2))
        .when(c("what").isin("function", "declared", "untyped"), F.regexp_replace(function, "^::", "")).when(c("what") == "alias", part(_ALIAS, 1)).when(c("what") == "variable", part(_VARIABLE, 1))
    )
    keyword = F.coalesce(F.when(c("what") == "tag", part(_TAG, 2)), F.when(c("what") == "forward", part(_FORWARD, 1)))
    s = s.withColumns({"local": local, "keyword": keyword})
    # names behind the block of a typedef: its closing brace knows the opening one, and is known to the segment after it
    opened = F.when(c("what").isin("tag", "nameless") & part(_TAG, 1).isNotNull(), F.struct("at", "line"))
    s = s.withColumn("typedef", F.when(c("end") == "}", F.lag(opened).over(level)))
    return s.withColumn("typedef", F.lag("typedef").over(Window.partitionBy("relative_path").orderBy("segment")))


def _scoped(s: DataFrame) -> DataFrame:
    """Segments with ``scope``: what encloses them, outermost first (what, local).

    Blocks are compared with the named blocks of their file only; every other segment takes the scope
    that the last brace before it left.
    """
    c = F.col
    blocks = s.where(c("what").isin("namespace", "linkage", "tag", "nameless", "function") & (c("end") == "{"))
    outer = blocks.select("relative_path", F.col("segment").alias("o_segment"), F.col("close").alias("o_close"), F.struct(F.col("segment").alias("at"), "what", "local").alias("o"))
    inside = (c("o_segment") < c("segment")) & (c("o_close").isNull() | (c("segment") < c("o_close")))
    own = blocks.select("relative_path", "segment", "close", F.struct(F.col("segment").alias("at"), "what", "local").alias("me"))
    chains = own.join(outer, ["relative_path"]).where(inside).groupBy("relative_path", "segment").agg(F.array_sort(F.collect_list("o")).alias("chain"))
    own = own.join(chains, ["relative_path", "segment"], "left")
    # a block that looks like a function right inside of a function is a statement by macro
    nested = lambda chain, x: (x["what"] == "function") & (F.coalesce(F.get(F.filter(chain, lambda y: y["at"] < x["at"]), F.size(F.filter(chain, lambda y: y["at"] < x["at"])) - 1)["what"], F.lit("")) == "function")
    chain = F.coalesce("chain", F.array().cast("array<struct<at:bigint,what:string,local:string>>"))
    own = own.withColumn("all", F.concat(chain, F.array("me")))
    own = own.withColumn("real", F.filter("all", lambda x: ~nested(c("all"), x)))
    own = own.where(F.element_at("real", -1)["at"] == c("segment"))
    kept = F.transform("real", lambda x: F.struct(x["what"].alias("what"), x["local"].alias("local")))
    opened = own.select("relative_path", "segment", kept.alias("leaves"))
    left = own.where("close IS NOT NULL").select("relative_path", F.col("close").alias("segment"), F.slice(kept, F.lit(1), F.size("real") - 1).alias("leaves"))
    before = Window.partitionBy("relative_path").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    s = s.join(opened.union(left), ["relative_path", "segment"], "left")
    nothing = F.array().cast("array<struct<what:string,local:string>>")
    return s.withColumn("block", F.col("leaves").isNotNull() & (c("end") == "{")).withColumn("scope", F.coalesce(F.last("leaves", ignorenulls=True).over(before), nothing))


def parse_clike(files: DataFrame) -> DataFrame:
    """Entries of C and C++ files (relative_path, language in ``c`` or ``cpp``, content): ``COLUMNS``.

    C: functions (definition or declaration), macros without arguments, tags, type aliases and global
    variables at file level, within linkage blocks and conditional directives. C++: classes, structs,
    enums, functions and methods by their qualified names. Both: includes, and calls with their caller.
    A null content and a language other than these give nothing.
    """
    c = F.col
    files = files.where(F.col("language").isin("c", "cpp") & F.col("content").isNotNull()).select("relative_path", "language", F.decode("content", "utf-8").alias("text"))
    # texts are shuffled here, not their tokens; small as they are, they aren't coalesced, as tokens are many times their size
    files = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "relative_path")
    # written once: the scopes read segments five times, and each time all tokens would be made and sorted anew
    s = _scoped(materialize(_classified(_segments(_tokens(files))).select(*SEGMENT), "segments"))
    in_c = c("language") == "c"
    inner = F.get("scope", F.size("scope") - 1)
    named = lambda chain: F.array_join(F.array_compact(F.transform(chain, lambda x: x["local"])), "::")
    within = F.nullif(named(c("scope")), F.lit(""))
    qualified = F.when(in_c | within.isNull(), c("local")).otherwise(F.concat_ws("::", within, "local"))
    in_class = F.coalesce(inner["what"] == "tag", F.lit(False))
    outside = F.forall("scope", lambda x: x["what"] == "linkage")
    hidden = F.exists("scope", lambda x: x["what"] == "nameless")
    maker = (c("what") == "untyped") & (c("local").startswith("~") | (c("local") == inner["local"]))
    tag = c("what").isin("tag", "forward") & F.when(in_c, c("keyword") != "class").otherwise(c("keyword") != "union")
    defined = (c("what") == "function") & c("block")
    wanted = F.when(in_c, outside & (tag | defined | c("what").isin("declared", "alias", "variable"))).otherwise(~hidden & (tag | defined | (in_class & ((c("what") == "declared") | maker))))
    kind = (
        F.when(c("what").isin("tag", "forward"), c("keyword")).when(c("what") == "alias", F.lit("type_alias")).when(c("what") == "variable", F.lit("variable"))
        .when(~in_c & (in_class | F.contains("local", F.lit("::"))), F.lit("method")).otherwise(F.lit("function"))
    )
    seen = F.when(defined, F.lit("definition")).when(c("what").isin("declared", "untyped"), F.lit("declaration"))
    text = lambda start, to: F.substring("text", start.cast("int") + 1, (to - start).cast("int"))
    empty = F.lit(None).cast("string")

    def entry(given: Column, **values: Column) -> Column:
        """A struct of the entry's columns where ``given`` holds, null elsewhere."""
        places = {"start_line": c("line"), "end_line": c("end_line")} | values
        return F.when(given, F.struct(*[places.get(name, F.lit(None)).cast("int" if name.endswith("line") else "string").alias(name) for name in COLUMNS[1:]]))

    until = F.coalesce("close_at", F.when(tag, c("head_at")), "end_at")
    short = F.when(c("what").isin("tag", "forward"), F.concat_ws(" ", "keyword", "local"))
    symbol = entry(
        wanted & c("local").isNotNull(), entry=F.lit("symbol"), name=F.element_at(F.split("local", "::"), -1), qualified_name=qualified, kind=kind, parent=F.when(~in_c, within),
        end_line=F.coalesce("close_line", "end_line"), content_hash=F.sha2(text(c("at"), until), 256), signature=F.coalesce(short, F.when(seen.isNotNull(), text(c("at"), c("head_at")))), visibility=seen,
    )
    name = F.nullif(F.regexp_extract("head", r"([A-Za-z_]\w*)(?: \[.*\])?$", 1), F.lit(""))
    alias = entry(
        in_c & outside & c("typedef.at").isNotNull() & (c("end") == ";") & name.isNotNull(), entry=F.lit("symbol"), name=name, qualified_name=name, kind=F.lit("type_alias"), start_line=c("typedef.line"),
        content_hash=F.sha2(text(c("typedef.at"), c("end_at")), 256), signature=F.concat(F.lit("typedef ... "), name),
    )
    local, system, macro = F.regexp_extract("end", _INCLUDE, 1), F.regexp_extract("end", _INCLUDE, 2), F.regexp_extract("end", _MACRO, 1)
    target = F.concat(local, system)
    include = entry(c("directive") & (target != ""), entry=F.lit("import"), name=target, kind=F.when(local != "", F.lit("local")).otherwise(F.lit("external")), target=target)
    defined_macro = entry(c("directive") & in_c & outside & (macro != ""), entry=F.lit("symbol"), name=macro, qualified_name=macro, kind=F.lit("macro"), content_hash=F.sha2(F.trim("end"), 256), signature=F.concat(F.lit("#define "), macro))
    depth = F.array_max(F.transform("scope", lambda x, i: F.when(x["what"] == "function", i + 1)))
    caller = F.when(in_c, F.element_at("scope", depth)["local"]).otherwise(named(F.slice("scope", F.lit(1), depth)))
    called = lambda x: entry(depth.isNotNull(), entry=F.lit("call"), name=F.ltrim(x["name"], F.lit("~")), kind=F.lit("call"), parent=caller, start_line=x["line"], end_line=x["line"])
    broken = entry(c("last") & ((c("braces") != 0) | (c("parens") != 0) | (c("least") < 0)), entry=F.lit("error"), name=F.lit("unbalanced"), kind=F.lit("error"), start_line=c("end_line"))
    found = F.array_compact(F.concat(F.array(symbol, alias, include, defined_macro, broken), F.transform("calls", called)))
    return s.join(files, ["relative_path", "language"]).select("relative_path", F.explode(found).alias("e")).select("relative_path", "e.*")

"""Syntax points of source files: what starts where, as array expressions.

A file is a sequence of units: its lines, cut again where a statement ends or a
block opens and more code follows on the same line. Two facts per unit are
enough to find the points: how deep in brackets it starts, and how its code
begins. Comments and literals are blanked first, so neither is fooled by them.
What a unit that starts one bracket deep means depends on the statement around
it (function body, class, object); the tables below say which of its starts are
points, following the depth rule of the tool being replaced: every declaration
at the top, only functions and JSX of three or more lines down to syntax depth
3. In files that may hold markup a second level counts open elements, so markup
over many lines stays one statement and its elements have a depth.

Everything runs in the JVM on one row per file, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenseek import fixed_values as fv
from lumenseek.functions.text import literal_map
from lumenseek.operators.arrays import let, part, running_sum, shifted_back, shifted_on
from lumenseek.session import apply_steps, cached_steps

_MARK = "\x01"  # stands for the start of a comment

# Alternatives are unrolled and possessive: Java recurses on (a|b)* and would
# overflow its stack on long literals.
_BLOCK_COMMENT = r"/\*[\s\S]*?(?:\*/|\z)"
_STRINGS = r""""[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"""
_TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"


def _nesting_template(inner: str) -> str:
    """A template literal whose placeholders hold strings, one more pair of braces and ``inner`` templates."""
    plain, item = r"[^`{}\"']*+", rf"(?:{_STRINGS}|{inner})"
    braces = rf"\{{{plain}(?:{item}{plain})*+\}}"
    placeholder = rf"\$\{{{plain}(?:(?:{item}|{braces}){plain})*+\}}"
    return rf"`[^`\\$]*+(?:(?:\\[\s\S]|{placeholder}|\$(?!\{{))[^`\\$]*+)*+`"


_TEMPLATES = rf"{_nesting_template(_nesting_template(_TEMPLATE))}|{_TEMPLATE}"
_REGEX = r"(?<=(?:[(,=:\[!&|?{};]|=>|\b(?:return|typeof|case|in|of|delete|void|throw|else|do|yield|await))\s{0,4})/(?![*/])[^/\\\[\n]*+(?:(?:\\.|\[[^\]\n]*+\])[^/\\\[\n]*+)*+/[a-z]*"
_CUT = "\x02"  # stands where a line is cut into units

def _balanced(depth: int) -> str:
    """A pair of parentheses with pairs inside, so many deep."""
    inner = rf"(?:{_balanced(depth - 1)}[^()]*+)*+" if depth > 1 else ""
    return rf"\([^()]*+{inner}\)"


# A look at the next character comes first where a pattern looks behind, which would otherwise be tried at every place.
#: A brace that opens a block, a class or an object that is assigned, with code behind it.
_OPENS = (r"(?=\{)(?<=(?:[)\w$>\]]|=>?)\s{0,4})(?<!\b(?:import|export|const|let|var|from|return|type|of|in|case)\s{0,4})"
          r"\{(?=\s*[^\s}])")
#: A closing brace with the start of another statement or member behind it.
_CLOSES = (r"\}(?=\s*(?!(?:else|catch|finally|while|from|as|satisfies|instanceof|in|of|extends|implements|with)\b)[A-Za-z_$@#])")
_ENDS = r";(?=\s*[^\s;)])"
_CUTS = rf"(?=[{{}};])(?:{_OPENS}|{_CLOSES}|{_ENDS})"
_WHOLE_OR_CUT = rf"({_balanced(5)})|({_CUTS})"
_CSS_CUTS = r"(?<=\})(?=\s*[^\s}])"

_MARKUP_LANGUAGES = ("js", "jsx", "tsx")
#: Tags as they begin in markup: not type arguments, which follow a name, nor type parameters.
_TAG = r"(?=<)(?<![\w$)\].])<(?:[A-Za-z][\w.:-]*(?=[\s/>]|$)(?!>\(|\s+extends\b)|>(?!\())"
_TAG_ENDS = r"(?=[</])(?:</|/>)"
# Start of a top statement that holds markup -> syntax depth of its outermost element.
_BINDING = r"(?:const|let|var)\s[^()<]*=\s*"
MARKUP_HEADS = [
    (r"^(?:export\s+default\s*)?<[\w>]", 1), (rf"^{_BINDING}<[\w>]", 2), (rf"^{_BINDING}\($", 3),
    (rf"^export\s+{_BINDING}<[\w>]", 3), (r"^[\w$.]+\((?:<[\w>].*)?$", 3),
]

_SCRIPT_LEX = rf"//[^\n]*|{_BLOCK_COMMENT}|{_STRINGS}|{_TEMPLATES}|{_REGEX}|[^/\"'`]++|."
_CSS_LEX = rf"{_BLOCK_COMMENT}|{_STRINGS}|[^/\"']++|."

_FUNCTION_VALUE = (r"(?:async\s+)?(?:function\b(?!\s*\*)|\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)\s*(?::[^=]+)?=>"
                   r"|<[^>]*>\s*\(.*=>|[\w$]+\s*=>)")
_MODIFIER = r"(?:(?:static|async|get|set|public|private|protected|readonly|abstract|override)\s+)*"
_NOT_METHOD = r"(?!(?:if|for|while|switch|catch|return|function|new|await|throw|typeof)\b)"
_NAME = r"(?:[\w$#]+|\"\"|\[[^\]]*\])"

FUNCTION_DECLARATION = r"^(?:async\s+)?function\b(?!\s*\*)"
FUNCTION_VARIABLE = rf"^(?:const|let|var)\s.*?=\s*{_FUNCTION_VALUE}"
RETURNED_FUNCTION = rf"^return\s+{_FUNCTION_VALUE}"
RETURNED_MARKUP = r"^return\s*(?:\((?!.*=>)|<)"
METHOD = rf"^{_MODIFIER}\*?\s*{_NOT_METHOD}{_NAME}\s*(?:<[^>]*>)?\(.*[^;]$"
FUNCTION_FIELD = rf"^{_MODIFIER}{_NAME}\s*[?!]?(?::[^=]+)?=\s*{_FUNCTION_VALUE}"
FUNCTION_PAIR = rf"^{_NAME}\s*:\s*{_FUNCTION_VALUE}"
FUNCTION_ARGUMENT = r"^[\w$.\[\]]+\([^{}]*(?:=>|\bfunction\b)|^;?\((?:async\s+)?(?:function\b|\([^()]*\)\s*=>)"
ASSIGNED_FUNCTION = rf"^[\w$.\[\]\"]+\s*=\s*{_FUNCTION_VALUE}"
EXPORTED_FUNCTION = (rf"^export\s+(?:default\s+)?(?:(?:async\s+)?function\b(?!\s*\*)|{_FUNCTION_VALUE}"
                     rf"|(?:const|let|var)\s.*?=\s*{_FUNCTION_VALUE})")

#: Starts in the first column that are not inside anything, as files are commonly laid out.
FIRST_COLUMN = (r"^(?:import\b(?!\s*[.(])|export\b|(?:async\s+)?function\b|(?:abstract\s+)?class\b|interface\s|enum\s"
                r"|declare\s)")

# Start of a top statement -> its syntax labels, most specific first. The
# typed rules only hold for ts and tsx.
_TYPED, _ANY = ("ts", "tsx"), ("js", "jsx", "ts", "tsx", "vue")
TOP_LABELS = [
    (_ANY, r"^import\b(?!\s*[.(])", ["Import"]),
    (_ANY, EXPORTED_FUNCTION, ["Export", "Function"]),
    (_ANY, r"^export\b", ["Export"]),
    (_TYPED, r"^(?:async\s+)?function\b[^{]*;$", ["Function Signature", "Function"]),
    (_ANY, FUNCTION_DECLARATION, ["Function"]),
    (_TYPED, r"^abstract\s+class\b", ["Abstract Class"]),
    (_ANY, r"^class\b", ["Class"]),
    (_TYPED, r"^interface\s+[\w$]", ["Interface"]),
    (_TYPED, r"^(?:const\s+)?enum\s+[\w$]", ["Enum"]),
    (_TYPED, r"^type\s+[\w$]", ["Type Alias"]),
    (_TYPED, r"^declare\s+function\b", ["Ambient", "Function"]),
    (_TYPED, r"^declare\s+\w", ["Ambient"]),
    (_TYPED, r"^module\s+[\w\"]", ["Module"]),
    (_ANY, FUNCTION_VARIABLE, ["Function"]),
    (_ANY, r"^(?:const|let|var)\s", ["Variable"]),
    (_ANY, ASSIGNED_FUNCTION, ["Function"]),
    (_ANY, FUNCTION_ARGUMENT, ["Function"]),
]
CSS_LABELS = [(r"(?i)^@media", "Media Query"), (r"(?i)^@[\w-]*keyframes", "Keyframes"), (r"^[^@]", "Rule")]

# Start of a top statement -> what one bracket deep inside it is.
SURROUNDINGS = [
    (r"^export\s+(?:default\s+)?(?:async\s+)?function\b|^namespace\b", "deep body"),
    (r"^(?:async\s+)?function\b|^(?:if|for|while|try|do|with)\b|^module\s+[\w\"]|^\{", "body"),
    (r"^export\s+(?:default\s+)?(?:abstract\s+)?class\b", "deep class"),
    (r"^(?:abstract\s+)?class\b", "class"),
    (r"^export\s+default\s*\{", "options"),
    (r"^(?:const|let|var)\s[^()]*=\s*\{|^[\w$.\[\]\"]+\s*=\s*\{", "object"),
]
# Surrounding -> starts that are functions at syntax depth 3 or less.
NESTED_FUNCTIONS = {
    "body": [FUNCTION_DECLARATION, FUNCTION_VARIABLE, RETURNED_FUNCTION],
    "deep body": [FUNCTION_DECLARATION, FUNCTION_VARIABLE],
    "class": [METHOD, FUNCTION_FIELD],
    "deep class": [METHOD],
    "options": [METHOD, FUNCTION_PAIR],
    "object": [METHOD],
}


def _any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def blanked(text: Column, language: Column) -> Column:
    """The text with comments as marks and literals emptied, line breaks kept."""
    def blank(token: Column) -> Column:
        breaks = F.regexp_replace(token, "[^\n]+", "")
        quoted = F.length(token) > 1
        return (
            F.when(F.startswith(token, F.lit("//")) | F.startswith(token, F.lit("/*")), F.concat(F.lit(_MARK), breaks))
            .when(quoted & token.rlike("^[\"'`/]"), F.concat(F.lit('"'), breaks, F.lit('"')))
            .otherwise(token))

    tokens = F.when(language == "css", F.regexp_extract_all(text, F.lit(_CSS_LEX), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit(_SCRIPT_LEX), F.lit(0)))
    return F.array_join(F.transform(tokens, blank), "")


def _only_script(lines: Column) -> Column:
    """A component's lines with everything outside its script blocks emptied."""
    def opens(line: Column) -> Column:
        return line.rlike(r"^<script\b").cast("int")

    def closes(line: Column) -> Column:
        return F.contains(line, F.lit("</script")).cast("int")

    def code(line: Column, level: Column) -> Column:
        # Code may stand on the line of a tag.
        own = F.regexp_replace(F.regexp_replace(line, r"^<script\b[^>]*>", ""), r"</script[\s\S]*$", "")
        return F.when(level - opens(line) + closes(line) > 0, F.when(closes(line) > 0, own).otherwise(line)).when(
            opens(line) > 0, F.when(line.rlike("^<script\\b[^>]*>"), own).otherwise("")).otherwise("")

    levels = running_sum(F.transform(lines, lambda line: opens(line) - closes(line)))
    return F.zip_with(lines, levels, code)


def _units(lines: Column, language: Column) -> Column:
    """struct(row, code): the lines, cut where another statement begins on the same line.

    Only what follows a cut outside of balanced parentheses becomes a unit of
    its own; it never starts in the first column.
    """
    def cut(line: Column) -> Column:
        # A pair of parentheses is matched to be passed over, and marked as the cuts are; its mark goes again.
        marked = F.regexp_replace(line, _WHOLE_OR_CUT, f"$1$2{_CUT}")
        script = F.when(line.rlike(_CUTS), F.split(F.replace(marked, F.lit(f"){_CUT}"), F.lit(")")), _CUT)).otherwise(F.array(line))
        return F.when(language == "css", F.when(line.rlike(_CSS_CUTS), F.split(F.regexp_replace(line, _CSS_CUTS, _CUT), _CUT))
                      .otherwise(F.array(line))).otherwise(script)

    return F.flatten(F.transform(lines, lambda line, row: F.transform(cut(line), lambda code, n: F.struct(
        row.alias("row"), F.when(n > 0, F.concat(F.lit(" "), code)).otherwise(code).alias("code")))))


def _tag_balance(code: Column) -> Column:
    counted = F.regexp_count(code, F.lit(_TAG)) - F.regexp_count(code, F.lit(_TAG_ENDS))
    return F.when(F.contains(code, F.lit("<")) | F.contains(code, F.lit("/>")), counted).otherwise(0)


def _unit_facts(units: Column, after: Column, tags: Column) -> Column:
    """struct(at, row, before, after, tags, code): a unit's place and line, the bracket level around it, open tags
    before it and its code."""
    joined = F.arrays_zip(units.alias("unit"), after.alias("after"), tags.alias("tags"))
    return F.transform(joined, lambda x, at: F.struct(
        at.alias("at"), x["unit"]["row"].alias("row"), (x["after"] - _balance(x["unit"]["code"])).alias("before"),
        x["after"].alias("after"), F.coalesce(x["tags"], F.lit(0)).alias("tags"),
        F.btrim(x["unit"]["code"], F.lit(f" \t\r{_MARK}")).alias("code")))


def _balance(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[({\[]")) - F.regexp_count(line, F.lit(r"[)}\]]"))


def _recovered(lines: Column, after: Column) -> Column:
    """Levels that start again at declarations in the first column.

    A literal that the lexer cannot tell from operators may leave a bracket
    open; this keeps it from hiding the rest of the file.
    """
    before = F.zip_with(lines, shifted_back(after), lambda line, level: F.when((level > 0) & line.rlike(FIRST_COLUMN), level))

    def lowered(stuck: Column) -> Column:
        resets = F.filter(stuck, lambda level: level.isNotNull())
        passed = running_sum(F.transform(stuck, lambda level: level.isNotNull().cast("int")))
        return F.when(F.exists(stuck, lambda level: level.isNotNull()), let(resets, lambda known: F.zip_with(
            after, passed, lambda level, n: level - F.coalesce(F.get(known, n - 1), F.lit(0))))).otherwise(after)

    return let(before, lowered)


def _point(row: Column, label: Column) -> Column:
    return F.struct(row.alias("line"), label.alias("label"))


def _top_labels(code: Column, language: Column) -> Column:
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for languages, pattern, labels in TOP_LABELS:
        fits = code.rlike(pattern)
        if languages is _TYPED:
            fits = language.isin(*_TYPED) & fits
        out = out.when(fits, F.array(*map(F.lit, labels)))
    return out.otherwise(F.array().cast("array<string>"))


def _header(line: Column, rest: Column) -> Column:
    """A line's code; one that ends inside its parameters gets the line that closes them."""
    closing = F.filter(rest, lambda x: (x["before"] == line["before"] + 1) & F.startswith(x["code"], F.lit(")")))
    return F.when(line["code"].rlike(r"[(,]$") & (line["after"] == line["before"] + 1),
                  F.concat(line["code"], F.coalesce(F.get(closing, F.lit(0))["code"], F.lit("")))
                  ).otherwise(line["code"])


def _surrounding(code: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for pattern, kind in SURROUNDINGS:
        out = out.when(code.rlike(pattern), kind)
    return out.otherwise("")


def _nested_points(top: Column, language: Column) -> Column:
    """Points among the units one bracket deep in a top statement."""
    around, body = top["around"], top["body"]

    def label(x: Column) -> Column:
        function = F.lit(False)
        for kind, patterns in NESTED_FUNCTIONS.items():
            function = function | ((around == kind) & x["head"].rlike(_any_of(patterns)))
        last = F.get(F.filter(x["own"], lambda y: y["after"] <= 1), F.lit(0))["row"]
        tall = (last - x["row"] + 1 >= fv.JSX_MIN_LINES) | x["code"].rlike(r"^return\s*<[^;]*[^;/]>$|^return\s*<\w+$")
        markup = (around.isin("body", "deep body") & (language != "vue") & x["code"].rlike(RETURNED_MARKUP) & tall)
        return F.when(markup, "JSX").when(function, "Function")

    level_one = F.filter(body, lambda x: (x["before"] == 1) & x["code"].rlike(r"^[\w$#*\[\"]"))
    # Each with the units up to the next one.
    spans = let(level_one, lambda ones: F.zip_with(ones, shifted_on(ones), lambda x, after: F.struct(x.alias("x"), part(
        body, x["at"] - top["at"] - 1, F.coalesce(after["at"] - top["at"] - 1, F.size(body)) - (x["at"] - top["at"] - 1)).alias("own"))))
    headed = F.transform(spans, lambda s: F.struct(
        s["x"]["row"].alias("row"), s["x"]["code"].alias("code"), s["own"].alias("own"),
        _header(s["x"], F.filter(s["own"], lambda y: y["at"] > s["x"]["at"])).alias("head")))
    return F.filter(F.transform(headed, lambda x: _point(x["row"], label(x))), lambda p: p["label"].isNotNull())


def _markup_points(top: Column) -> Column:
    """JSX points of a top statement that is or holds markup: its elements of three or more lines down to depth 3.

    An element counts where it begins a line, directly in the element around it.
    """
    depth = F.when(F.lit(False), F.lit(0))
    for pattern, outermost in MARKUP_HEADS:
        depth = depth.when(top["code"].rlike(pattern), outermost)

    def found(d: Column) -> Column:
        head = F.struct(top["at"].alias("at"), top["row"].alias("row"), F.lit(0).alias("before"), top["after"].alias("after"),
                        top["tags"].alias("tags"), F.regexp_replace(top["code"], r"^[^<]*(?=<[\w>])", "").alias("code"))
        return let(F.transform(F.concat(F.array(head), top["body"]), lambda x: x.withField(
            "closed", x["tags"] + _tag_balance(x["code"]))), lambda units: elements(d, units))

    def elements(d: Column, units: Column) -> Column:
        inside = F.when(top["code"].rlike(r"\((?:<[\w>].*)?$"), 1).otherwise(0)
        starts = F.filter(units, lambda x: x["code"].rlike(r"^<[\w>]") & (d + x["tags"] - top["tags"] <= 3)
                          & ((x["before"] == inside) | (x["at"] == top["at"])))

        def tall(x: Column) -> Column:
            end = F.get(F.filter(units, lambda y: (y["at"] >= x["at"]) & (y["closed"] <= x["tags"])), F.lit(0))
            return end["row"] - x["row"] + 1 >= fv.JSX_MIN_LINES

        return F.transform(F.filter(starts, tall), lambda x: _point(x["row"], F.lit("JSX")))

    return F.when(depth.isNotNull() & ~top["code"].rlike(FUNCTION_VARIABLE), let(depth, found)).otherwise(
        F.array().cast("array<struct<line:int,label:string>>"))


def _option_points(body: Column) -> Column:
    """Points of a component's options object: hooks, data, nested functions, props, emits."""
    ones = F.filter(body, lambda x: x["before"] == 1)

    def of_line(x: Column, after: Column) -> Column:
        name = F.regexp_extract(x["code"], rf"^{_MODIFIER}([\w$]+)", 1)
        method = x["code"].rlike(METHOD)
        own = F.when(method & name.isin(*fv.LIFECYCLE_HOOKS), "Lifecycle Hook").when(
            method & (name == "data"), "Data Function").when(
            x["code"].rlike(r"^\w+\s*:"), F.element_at(literal_map(fv.OPTION_PAIRS), name))
        nested = F.element_at(literal_map(fv.NESTED_OPTIONS), name)
        end = F.coalesce(after["at"], F.lit(2**31 - 1))
        inner = F.filter(body, lambda y: (y["at"] > x["at"]) & (y["at"] < end) & (y["before"] == 2)
                         & y["code"].rlike(_any_of([METHOD, FUNCTION_PAIR])))
        return F.concat(
            F.filter(F.array(_point(x["row"], own)), lambda p: p["label"].isNotNull()),
            F.when(nested.isNotNull() & x["code"].rlike(r"^\w+\s*:\s*\{"),
                   F.transform(inner, lambda y: _point(y["row"], nested))
                   ).otherwise(F.array().cast("array<struct<line:int,label:string>>")))

    return F.flatten(let(ones, lambda known: F.zip_with(known, shifted_on(known), of_line)))


def _script_points(facts: Column, tops: Column, language: Column, compat: bool) -> Column:
    """Points of every top statement and of the lines one bracket deep inside it.

    Each transform binds what the next one uses, so no pattern is tried twice.
    """
    nothing = F.array().cast("array<struct<line:int,label:string>>")
    spans = F.zip_with(tops, shifted_on(tops), lambda x, after: F.struct(
        x.alias("x"), part(facts, x["at"] + 1, F.coalesce(after["at"], F.size(facts)) - x["at"] - 1).alias("body")))
    stated = F.transform(spans, lambda s: F.struct(
        s["x"]["row"].alias("row"), s["x"]["at"].alias("at"), s["x"]["after"].alias("after"), s["x"]["tags"].alias("tags"),
        s["x"]["code"].alias("code"), _header(s["x"], s["body"]).alias("head"), s["body"].alias("body"),
        F.when(F.size(s["body"]) > 0, _surrounding(s["x"]["code"])).otherwise("").alias("around")))

    def of_top(top: Column) -> Column:
        own = F.transform(_top_labels(top["head"], language), lambda label: _point(top["row"], label))
        nested = F.when(top["around"] != "", _nested_points(top, language)).otherwise(nothing)
        options = F.when((language == "vue") & (top["around"] == "options"), _option_points(top["body"])).otherwise(nothing)
        markup = F.when(language.isin(*_MARKUP_LANGUAGES) & (F.size(top["body"]) > 0), _markup_points(top)).otherwise(nothing)
        # The first point of a line names it; compat lets plain functions shadow the hooks.
        return F.concat(own, nested, options, markup) if compat else F.concat(own, options, nested, markup)

    return F.flatten(F.transform(stated, of_top))


def _without_own_braces(tops: Column) -> Column:
    """Top lines without a brace that opens the body of the statement above it."""
    pairs = F.zip_with(tops, shifted_back(tops), lambda x, b: F.struct(x.alias("x"), F.coalesce(
        (x["code"] == "{") & (b["after"] <= 0) & b["code"].rlike(r"[^;{}]$"), F.lit(False)).alias("opens")))
    return F.transform(F.filter(pairs, lambda p: ~p["opens"]), lambda p: p["x"])


def _decorator_rows(facts: Column, level: int) -> Column:
    """Lines of the decorators that start at a bracket level, up to what they stand above."""
    starts = F.filter(facts, lambda x: (x["before"] <= level) & (x["code"] != ""))
    pairs = let(starts, lambda known: F.zip_with(known, shifted_on(known), lambda x, after: F.struct(
        x.alias("x"), after.alias("after"))))
    # What stands on a decorator's own line after it is the decorated thing itself.
    spans = F.filter(pairs, lambda p: (p["x"]["before"] == level) & (p["after"]["row"] > p["x"]["row"]) & (
        p["x"]["code"].rlike(rf"^@[\w$.]+\s*(?:{_balanced(5)})?$")
        | p["x"]["code"].rlike(r"^@[\w$.]+\s*\(") & (p["x"]["after"] > level)))
    return F.flatten(F.transform(spans, lambda p: F.sequence(p["x"]["row"], p["after"]["row"] - 1)))


def _css_points(tops: Column) -> Column:
    """A rule starts on the first line at bracket level 0 after the one before ended."""
    label = F.when(F.lit(False), F.lit(""))

    def of_line(x: Column, before: Column) -> Column:
        out = label
        for pattern, name in CSS_LABELS:
            out = out.when(x["code"].rlike(pattern), name)
        fresh = before.isNull() | before["code"].rlike("[};]$")
        return _point(x["row"], F.when(fresh & (x["code"] != ""), out))

    coded = F.filter(tops, lambda x: x["code"] != "")
    # A rule's closing line starts one level deep, so an opening line also ends a run.
    pairs = let(coded, lambda known: F.zip_with(known, shifted_back(known), lambda x, b: F.struct(x.alias("x"), F.when(
        b["after"] > 0, F.lit(None)).otherwise(b).alias("b"))))
    return F.filter(F.transform(pairs, lambda p: of_line(p["x"], p["b"])), lambda p: p["label"].isNotNull())


def _component_points(lines: Column) -> Column:
    """The blocks of a single-file component."""
    rows = F.transform(lines, lambda line, i: _point(
        i, F.initcap(F.nullif(F.regexp_extract(line, r"^<(script|style|template)\b", 1), F.lit("")))))
    return F.filter(rows, lambda p: p["label"].isNotNull())


@cached_steps
def _scan_steps(compat: bool):
    language = F.col("language")
    is_vue = language == "vue"
    steps = [("lines", F.split("text", "\n", -1))]
    steps.append(("_code", F.when(is_vue, F.array_join(_only_script(F.col("lines")), "\n")).otherwise(F.col("text"))))
    steps.append(("_blank", F.split(blanked(F.col("_code"), language), "\n", -1)))
    steps.append(("_unit", _units(F.col("_blank"), language)))
    codes = F.transform("_unit", lambda u: u["code"])
    steps.append(("_after", running_sum(F.transform("_unit", lambda u: _balance(u["code"])))))
    steps.append(("_after", F.when(language == "css", F.col("_after")).otherwise(_recovered(codes, F.col("_after")))))
    # Open tags after each unit, then before it.
    open_tags = let(running_sum(F.transform("_unit", lambda u: _tag_balance(u["code"]))), lambda after: _recovered(codes, after))
    steps.append(("_tags", F.when(language.isin(*_MARKUP_LANGUAGES) & F.exists("_unit", lambda u: u["code"].rlike(_TAG)),
                                  let(open_tags, shifted_back)).otherwise(F.array().cast("array<int>"))))
    steps.append(("_facts", _unit_facts(F.col("_unit"), F.col("_after"), F.col("_tags"))))
    steps.append(("_tops", F.filter("_facts", lambda x: (x["before"] <= 0) & (x["tags"] <= 0) & (
        (x["code"] != "") | (x["after"] > 0)))))
    steps.append(("_tops", F.when(language == "css", F.col("_tops")).otherwise(_without_own_braces(F.col("_tops")))))
    script = _script_points(F.col("_facts"), F.col("_tops"), language, compat)
    if compat:
        script = F.transform(script, lambda p: _point(p["line"] - F.when(is_vue, 1).otherwise(0), p["label"]))
    steps.append(("_found", F.when(language == "css", _css_points(F.col("_tops"))).when(
        is_vue, F.concat(script, _component_points(F.col("lines")))).otherwise(script)))
    steps.append(("points", F.transform("_found", lambda p, i: F.struct(
        p["line"].alias("line"), i.alias("seq"), p["label"].alias("label")))))
    # Decorators belong to what they stand above, just as comments do.
    noted = F.array_compact(F.transform("_blank", lambda line, i: F.when(F.contains(line, F.lit(_MARK)), i)))
    decorated = F.when((language != "css") & F.exists("_blank", lambda line: line.rlike(r"^\s*@")), F.concat(
        _decorator_rows(F.col("_facts"), 0), _decorator_rows(F.col("_facts"), 1))).otherwise(F.array().cast("array<int>"))
    rows = F.array_sort(F.array_union(noted, decorated))
    markup = F.transform("lines", lambda line, i: F.when(F.contains(line, F.lit("<!--")), i))
    steps.append(("comments", F.array_compact(F.when(is_vue, markup).otherwise(rows))))
    return steps


def scan_syntax(files: DataFrame, *, compat: bool = False) -> DataFrame:
    """Adds ``lines``, ``points`` and ``comments`` to files with ``text`` and ``language``.

    ``points`` is an array of (line, seq, label) in visit order, ``comments``
    the lines on which a comment starts; lines are 0-based. ``compat=True``
    keeps two quirks for Vue components: script points one line early and
    hooks named as plain functions.
    """
    staged = apply_steps(files, _scan_steps(compat))
    return staged.drop("_code", "_blank", "_unit", "_after", "_tags", "_facts", "_tops", "_found")


def top_level_kinds(scanned: DataFrame) -> DataFrame:
    """Kinds of the labelled nodes at the top of each file, for diagnosis."""
    kinds = F.transform(F.filter("points", lambda p: F.element_at(literal_map(fv.TOP_KINDS), p["label"]).isNotNull()),
                        lambda p: F.struct(p["line"].alias("line"), F.element_at(
                            literal_map(fv.TOP_KINDS), p["label"]).alias("kind")))
    return scanned.select("file_path", kinds.alias("kinds"))

"""Small text functions as column expressions: lists in words, tags, language of pasted code, questions, links, keys, errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import plain

# Expressions that tell languages, questions, links and daily limits apart.
CODE_LANGUAGES = (
    ("c", r"#include\s*[<\"]"),
    ("java", r"\b(public|private)\s+(static\s+)?(class|void)\b"),
    ("python", r"(?m)^\s*(def |import |from \w+ import|class \w+.*:)"),
    ("typescript", r":\s*(string|number|boolean)\b|\binterface\s+\w+\s*\{"),
    ("javascript", r"\b(function|const|let|=>)\b"),
)
C_MAIN = r"\bint\s+main\s*\("
CONCEPT = (
    r"(?i)^\s*(what('?s| is| are| does)\b|why\b|when (do|should|would)\b|how (do|does|can) (i|you|we) use\b|explain\b|define\b|meaning of\b|what do(es)? .* mean\b)|"
    r"\bused for\b|\bpurpose of\b|\bmean(s|ing)?\b"
)
SPECIFIC = r"(?i)\b(in|inside) [\w.]+\(\)|\b(this|that) (loop|function|if|switch)|\bthe \w+ in\b|\w+\(\)"
GENERAL = r"(?i)\b(program|project|app|application|whole|overall|start|starts|begin|main idea)\b"
POINTING = r"(?i)\b(this|here|it)\b"
REPOSITORY = r"^(?:https?://)?(?:www\.)?github\.com/([A-Za-z0-9-]{1,39})/([A-Za-z0-9._-]{1,100}?)(?:\.git)?(?:/tree/([A-Za-z0-9._/-]{1,200}))?/?$"
CITATION = r"\[([\w./\\-]+\.\w+):(\d+)(?:\s*[-–]\s*(\d+))?\]"
DAILY = r"(?i)per ?day|daily|RPD|TPD"
KEY_STYLES = (("AIza", "AI Studio style (AIza...)"), ("AQ.", "Vertex AI express style (AQ....)"), ("gsk_", "Groq style (gsk_...)"), ("sk-ant-", "Anthropic style (sk-ant-...)"))


def in_a_row(items: Column) -> Column:
    """Strings with commas, and `and` before the last."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def counted(n: Column, word: Column) -> Column:
    """n and the word, with an s unless n is 1."""
    return F.concat(n.cast("string"), F.lit(" "), word, F.when(n == 1, "").otherwise("s"))


def with_article(word: Column) -> Column:
    return F.concat(F.when(F.lower(F.substring(word, 1, 1)).isin(*"aeiou"), "an ").otherwise("a "), word)


def tag(text: Column) -> Column:
    """Lower case, other signs than letters, digits and + # . - to hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9+#.-]+", "-"), "^-+|-+$", "")


def code_language(code: Column) -> Column:
    """The language of pasted code, by the first expression that it meets; python if none."""
    out = F.lit("python")
    for name, expression in reversed(CODE_LANGUAGES):
        own = code.rlike(plain(expression))
        out = F.when(own | (code.rlike(plain(C_MAIN)) & ~F.contains(code, F.lit("public"))) if name == "c" else own, name).otherwise(out)
    return out


def concept_question(question: Column, terms: Column) -> Column:
    """Whether a question is about an idea: it names a term, asks for a meaning, and points at no piece of code."""
    return (F.size(terms) > 0) & question.rlike(plain(CONCEPT)) & ~question.rlike(plain(SPECIFIC))


def general_question(question: Column) -> Column:
    return question.rlike(plain(GENERAL))


def pointing_question(question: Column) -> Column:
    return question.rlike(plain(POINTING))


def repository(url: Column) -> Column:
    """struct<owner, name, branch> of a repository's link; null if it's no such link."""
    flat = F.trim(url)
    part = lambda k: F.nullif(F.regexp_extract(flat, REPOSITORY, k), F.lit(""))
    return F.when(flat.rlike(REPOSITORY), F.struct(part(1).alias("owner"), part(2).alias("name"), part(3).alias("branch")))


def json_part(text: Column) -> Column:
    """The object in a fenced block; without one, from the first brace to the last; else the trimmed text."""
    flat = F.trim(text)
    fenced = F.regexp_extract(flat, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    first, last = F.instr(flat, "{"), F.length(flat) - F.instr(F.reverse(flat), "}") + 1
    bare = (first > 0) & (F.instr(flat, "}") > 0) & (last > first)
    return F.when(fenced != "", fenced).when(bare, F.substring(flat, first, last - first + 1)).otherwise(flat)


def redacted(text: Column, keys: list[str]) -> Column:
    """Without the keys of more than six characters."""
    out = text
    for k in keys:
        if len(k) > 6:
            out = F.replace(out, F.lit(k), F.lit("***"))
    return out


def key_hint(key: Column) -> Column:
    """The kind and length of a key, and not the key."""
    kind = F.lit("unknown format")
    for start, said in reversed(KEY_STYLES):
        kind = F.when(key.startswith(start), said).otherwise(kind)
    odd = F.when(key != F.regexp_replace(F.trim(key), "^[\"']+|[\"']+$", ""), " - has spaces or quotes around it!").otherwise("")
    return F.when(F.coalesce(key, F.lit("")) == "", "missing").otherwise(F.concat(F.lit("set, "), kind, F.lit(", "), F.length(key), F.lit(" characters"), odd))


def error_kind(status: Column, code: Column, message: Column) -> Column:
    """rate, daily, overloaded, region, auth, model or bad_request, in this order of tests."""
    low = F.lower(message)
    limited = (status == 429) | (code == "RESOURCE_EXHAUSTED") | F.contains(F.lower(code), F.lit("rate_limit"))
    return (
        F.when(limited & message.rlike(DAILY), "daily")
        .when(limited, "rate")
        .when(status.isin(500, 502, 503, 504, 529) | code.isin("UNAVAILABLE", "INTERNAL", "overloaded_error"), "overloaded")
        .when(F.contains(low, F.lit("location is not supported")) | (F.contains(low, F.lit("region")) & F.contains(low, F.lit("not supported"))), "region")
        .when(status.isin(401, 403) | F.contains(low, F.lit("api key")) | F.contains(low, F.lit("authentication")), "auth")
        .when((status == 404) | low.rlike("not found|not supported for generatecontent|model_not_found|does not exist"), "model")
        .otherwise("bad_request")
    )


def summary_of_code(path: Column, doc: Column, names: Column) -> Column:
    """One line on a file without a model: its own comment's first sentence, else what it defines."""
    from tessera.functions.text import first_sentence

    first = first_sentence(doc)
    n = F.size(names)
    shown = F.concat(F.array_join(F.slice(names, 1, 4), ", "), F.when(n > 4, F.concat(F.lit(" and "), n - 4, F.lit(" more"))).otherwise(""))
    return (
        F.when(first != "", first)
        .when(path.endswith(".h"), "A header file: it lists functions so other files can use them.")
        .when(n == 0, "No functions here; it may hold settings or a small script.")
        .otherwise(F.concat(F.lit("Defines "), counted(n, F.lit("function")), F.lit(": "), shown, F.lit(".")))
    )

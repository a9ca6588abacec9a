"""Path and text classifiers as case expressions: layers, safe paths, skip reasons, generated and trivial files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import lines

# Layers from top to bottom, with the folder names that suggest them.
FOLDERS = {
    "UI": "ui components component views view pages page screens widgets templates layouts frontend client static public styles hooks",
    "API": "api apis routes router routers controllers controller handlers endpoints rest graphql resolvers server web cli commands middleware",
    "Service": "services service core domain business logic usecases engine workers jobs tasks",
    "Data": "models model db database databases repository repositories repo repos dao entities entity schema schemas migrations store stores storage persistence orm data",
    "Utility": "utils util utilities helpers helper common shared lib libs tools support misc internal",
}
# Patterns of file stems, in the order in which they're tried.
STEMS = (
    ("API", "^(main|app|server|cli|__main__|index|routes?|api|urls|views)$|(controller|handler|resource|endpoint|router)s?$"),
    ("Data", "^(models?|db|database|schema|entities|store)$|(repository|repo|dao|entity|model|schema|record)s?$"),
    ("Service", "(service|manager|engine|processor|provider|usecase)s?$"),
    ("Utility", "^(utils?|helpers?|common|constants?|config|settings)$|(util|utils|helper|helpers)$"),
)
TEST_FOLDER = "^(__tests__|tests?|specs?|testing|e2e)([-_.].*)?$"
TEST_FILE = "^(test_.*|.*_test|.*[.](test|spec)|.*Tests?|conftest)$"
# Folders that aren't read, names and extensions of secrets, extensions of code.
SKIP_FOLDERS = (
    ".git .hg .svn node_modules bower_components __pycache__ .venv venv env .env .tox .nox .mypy_cache .pytest_cache .ruff_cache site-packages "
    "dist build out target coverage .next .nuxt .turbo .cache .idea .vscode .gradle"
).split()
SECRET_NAMES = "id_rsa id_dsa id_ecdsa id_ed25519 .netrc .npmrc .pypirc credentials credentials.json secrets.json secrets.yaml secrets.yml service-account.json .htpasswd .git-credentials".split()
SECRET_EXTENSIONS = "pem key p12 pfx keystore jks crt der".split()
GENERATED_FOLDERS = "generated __generated__ gen vendor vendors third_party thirdparty external migrations".split()
GENERATED_NAME = r"(?i)(_pb2(_grpc)?[.]py|[.]pb[.]\w+|[.]generated[.]\w+|[.]g[.]\w+|[.]min[.]js|[.]bundle[.]js)$"
GENERATED_HEADER = "(?i)(auto-?generated|@generated|do not edit|generated by)"
LANGUAGES = {"py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "java": "java", "c": "c", "h": "c"}


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _base(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(file_name(path), "^(.+)[.][^.]*$", "$1")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), "^.+[.]([^./]*)$", 1))


def _folders(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def guess_layer(path: Column) -> Column:
    """Tests by folder or name; UI by extension; then the stem's pattern; then the deepest folder with a hint."""
    base = _base(path)
    stem = F.lower(F.substring_index(base, ".", 1))
    hints = F.create_map(*(F.lit(x) for layer, names in reversed(FOLDERS.items()) for n in names.split() for x in (n, layer)))
    hinted = F.filter(F.transform(F.reverse(_folders(path)), lambda p: F.try_element_at(hints, p)), lambda x: x.isNotNull())
    out = F.coalesce(F.get(hinted, F.lit(0)), F.lit("Unclassified"))
    for layer, pattern in reversed(STEMS):
        out = F.when(stem.rlike(pattern), layer).otherwise(out)
    out = F.when(file_name(path).rlike("[.](tsx|jsx)$"), "UI").otherwise(out)
    tests = F.exists(_folders(path), lambda p: p.rlike(TEST_FOLDER)) | base.rlike(TEST_FILE)
    return F.when(tests, "Tests").otherwise(out)


def resolve_layers(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """files (path, ai_layer) and overrides (key, layer) -> (path, layer, decided): the longest key that is the path or a folder above it, else
    the given layer, else the guess.

    A path's folders are unfolded, so the longest prefix is found by an equi join with a maximum, not by comparing all keys.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i == F.size(parts), F.col("path")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    keyed = files.select("path", F.explode(prefixes).alias("key")).join(overrides.withColumnRenamed("layer", "own"), "key")
    best = keyed.groupBy("path").agg(F.max_by("own", F.length("key")).alias("own"))
    guess = guess_layer(F.col("path"))
    found = files.join(best, "path", "left").withColumn("guess", guess)
    ai = F.col("ai_layer").isin(*FOLDERS) & (F.col("guess") != "Tests")
    return found.select("path", F.coalesce("own", F.when(ai, F.col("ai_layer")), "guess").alias("layer"), F.when(F.col("own").isNotNull(), "user").when(ai, "ai").otherwise("guess").alias("decided"))


def safe_path(name: Column) -> Column:
    """A clean relative path, or null: absolute paths, drives, .. and control characters are refused."""
    flat = F.replace(name, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(flat, "/"), lambda p: ~p.isin("", "."))
    bad = (flat == "") | flat.rlike("[\\x00-\\x1F]") | flat.startswith("/") | flat.rlike("^[A-Za-z]:") | (F.size(parts) == 0) | F.array_contains(parts, "..")
    return F.when(~bad, F.array_join(parts, "/"))


def skip_reason(path: Column) -> Column:
    """Why a path isn't kept; null if it is."""
    name = F.lower(file_name(path))
    parts = F.split(path, "/")
    above = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    ext = extension(path)
    return (
        F.when(F.exists(above, lambda p: p.isin(*SKIP_FOLDERS) | (p.startswith(".") & (p != "."))), "library or hidden folders")
        .when(name.startswith(".env") | name.isin(*SECRET_NAMES) | ext.isin(*SECRET_EXTENSIONS), "secret files")
        .when(name.rlike("^readme([.](md|txt|rst))?$"), None)
        .when(~ext.isin(*LANGUAGES), "not code")
        .when(F.contains(name, F.lit(".min.")) | name.endswith(".bundle.js"), "generated code")
    )


def language(path: Column) -> Column:
    ext = extension(path)
    out = F.lit("other")
    for e, lang in LANGUAGES.items():
        out = F.when(ext == e, lang).otherwise(out)
    return out


def is_generated(path: Column, text: Column) -> Column:
    """By folder, by name, or by what the first five lines say."""
    head = F.array_join(F.slice(lines(text), 1, 5), "\n")
    return F.arrays_overlap(_folders(path), F.array(*map(F.lit, GENERATED_FOLDERS))) | file_name(path).rlike(GENERATED_NAME) | head.rlike(GENERATED_HEADER)


def code_lines(text: Column) -> Column:
    """Lines that aren't blank and don't begin like a comment."""
    return F.size(F.filter(lines(text), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike("^(#|//|/[*]|[*])"))).cast("long")


def trivial(text: Column) -> Column:
    """What is said of a text of three code lines or fewer; null for others."""
    n = code_lines(text)
    return F.when(n == 0, "empty").when(n <= 3, F.concat(F.lit("very small: "), n, F.lit(" line(s)")))


def has_main_guard(text: Column) -> Column:
    return F.substring(text, 1, 200_000).rlike("__name__\\s*==\\s*['\"]__main__['\"]|public\\s+static\\s+void\\s+main\\s*\\(")

"""Scalar text functions: identifier tokenizers, normalisers, escapes, paths, predicates. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in names.
STOP_WORDS = ("", "a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with", "go", "py", "js", "ts", "tsx", "jsx", "java", "rb", "src", "lib", "pkg", "main", "init", "new", "impl", "util", "utils", "test", "tests", "spec", "specs", "id", "py_")

#: Architectural layers by words in a path, in order.
LAYERS = (("controller", "controller|handler|rest|api|resource"), ("service", "service|business|logic|usecase|application"), ("repository", "repository|repo|dao|store|persistence"), ("domain", "domain|model|entity|aggregate|valueobject"), ("infrastructure", "infra|infrastructure|adapter|config|configuration"))


def name_tokens(c: Column) -> Column:
    """Naming tokens: split on everything but letters and digits, then by case; lower case, over one character, no stop words."""
    parts = F.filter(F.split(c, r"[^\p{L}\p{Nd}]+"), lambda x: x != "")
    words = F.flatten(F.transform(parts, split_camel))
    return F.filter(F.transform(words, F.lower), lambda x: (F.length(x) > 1) & ~x.isin(*STOP_WORDS))


def split_camel(c: Column) -> Column:
    """Words of an identifier: lower|Upper, letter|digit and ACRONYM|Word boundaries, found by look-around in one pass."""
    bound = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
    return F.filter(F.split(c, bound), lambda x: x != "")


def search_tokens(c: Column) -> Column:
    """Search tokens of an identifier: the whole in lower case, then its parts; a digit starts no part, a capital after one does."""
    parts = F.filter(F.split(F.regexp_replace(c, r"[^A-Za-z0-9]+", " "), r" +|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"), lambda x: x != "")
    lower = F.transform(parts, F.lower)
    return F.when(F.size(lower) > 1, F.concat(F.array(F.lower(c)), lower)).otherwise(F.array(F.lower(c)))


def prefix_tokens(c: Column) -> Column:
    """Full lower-cased name and its alphanumeric runs of two and more characters."""
    low = F.lower(c)
    return F.array_distinct(F.concat(F.array(low), F.filter(F.split(low, "[^a-z0-9]+"), lambda x: F.length(x) > 1)))


def field_name(c: Column) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def canonical_key(c: Column) -> Column:
    """snake_case of any convention: CoreAdmin, CORE_ADMIN and core-admin are one."""
    s = F.regexp_replace(c, r"[^A-Za-z0-9]+", "_")
    s = F.regexp_replace(s, r"([a-z0-9])([A-Z])", "$1_$2")
    s = F.regexp_replace(s, r"([A-Z])([A-Z][a-z])", "$1_$2")
    s = F.regexp_replace(s, r"([A-Za-z])([0-9])", "$1_$2")
    return F.lower(F.regexp_replace(s, r"^_+|_+$", ""))


def join_path(c: Column) -> Column:
    """Route shape: parameters become {*}, lower case, no trailing slash, no leading /api[/vN] or /vN."""
    s = F.lower(F.regexp_replace(c, r"\{[^}]+\}|:[a-zA-Z][a-zA-Z0-9_]*|<[^>]+>", "{*}"))
    s = F.regexp_replace(s, r"/+$", "")
    s = F.regexp_replace(s, r"^/(?:api(?:/v[0-9]+)?|v[0-9]+)(/|$)", "$1")
    return F.when(s == "", "/").otherwise(s)


def normal_path(c: Column) -> Column:
    """Forward slashes, no leading ./ or /."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./|/)+", "")


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def extension(c: Column) -> Column:
    return F.regexp_extract(c, r"\.([^./]+)$", 1)


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_cypher(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def csv_ints(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def scrubbed(c: Column, salt: str) -> Column:
    """Salted hash of a name, 12 hex digits."""
    return F.substring(F.sha2(F.concat(F.lit(salt), c), 256), 1, 12)


def is_test_file(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests?|specs?|__tests__)/|(^|/)test_[^/]*\.py$|_test\.(go|py|rb)$|\.(test|spec)\.[jt]sx?$|Tests?\.(java|kt|cs)$")


def is_public_api_file(path: Column) -> Column:
    return path.rlike(r"(^|/)(index\.[jt]sx?|__init__\.py|mod\.rs|lib\.rs|main\.(go|py|rs))$")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; null for unequal lengths and zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def similar(a: Column, b: Column) -> Column:
    """One minus edit distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


#: License names as they are written, and their SPDX identifiers.
SPDX = {"apache 2": "Apache-2.0", "apache 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache-2.0": "Apache-2.0", "bsd": "BSD-3-Clause", "bsd-3-clause": "BSD-3-Clause", "bsd-2-clause": "BSD-2-Clause", "gpl": "GPL-3.0", "gpl-3.0": "GPL-3.0", "gplv3": "GPL-3.0", "gplv2": "GPL-2.0", "isc": "ISC", "lgpl": "LGPL-3.0", "mit": "MIT", "mit license": "MIT", "mpl-2.0": "MPL-2.0"}


def spdx(c: Column) -> Column:
    """SPDX identifier of a license name; null where it is unknown."""
    table = F.create_map(*[F.lit(x) for pair in SPDX.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(c)))


def license_severity(c: Column) -> Column:
    """What a dependency's SPDX license means for a permissive project."""
    return F.when(c.rlike("^A?GPL"), "error").when(c.rlike("^(LGPL|MPL|EPL)"), "warn").when(c.isNotNull(), "info").otherwise("unknown")


def migration_version(c: Column) -> Column:
    """Sequence key of a migration's file name: timestamp_, V1.2__, 0001_ and 000001_x.up.sql styles; null for others."""
    stamp, flyway, number = F.regexp_extract(c, r"^([0-9]{14})_", 1), F.regexp_extract(c, r"^V([0-9]+(?:[._][0-9]+)*)__", 1), F.regexp_extract(c, r"^([0-9]{3,6})_", 1)
    return F.when(stamp != "", stamp).when(flyway != "", F.replace(flyway, F.lit("_"), F.lit("."))).when(number != "", number)


def humanised(seconds: Column) -> Column:
    """just now, 5m ago, 3h ago, 2d ago."""
    ago = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds < 60, "just now").when(seconds < 3600, ago(60, "m ago")).when(seconds < 86400, ago(3600, "h ago")).otherwise(ago(86400, "d ago"))


def muted(ts: Column, start_hour: int, end_hour: int) -> Column:
    """Whether a time lies in a daily window, which may pass midnight."""
    h = F.hour(ts)
    return (h >= start_hour) & (h < end_hour) if start_hour <= end_hour else (h >= start_hour) | (h < end_hour)


def layer(path: Column) -> Column:
    """Architectural layer of a path: the first of LAYERS that has a word in it, else unknown."""
    low = F.lower(path)
    out = F.lit("unknown")
    for name, words in reversed(LAYERS):
        out = F.when(low.rlike(words), name).otherwise(out)
    return out


def embed_text(name: Column, signature: Column, body: Column, most_bytes: int = 1200) -> Column:
    """What is embedded of an entity: name, signature and body, cut to a number of bytes on a character's boundary."""
    whole = F.concat_ws("\n", name, signature, body)
    cut = F.make_valid_utf8(F.substring(whole.cast("binary"), 1, most_bytes).cast("string"))
    return F.when(F.octet_length(whole) <= most_bytes, whole).otherwise(F.regexp_replace(cut, "\uFFFD+$", ""))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of a text's UTF-8 bytes, as a long."""
    code = F.transform(F.regexp_extract_all(F.hex(c.cast("binary")), F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(code, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619) % 4294967296)


def module_root(path: Column, default_depth: int = 2) -> Column:
    """The first directories of a path, or _root for a file above them: what a path without a marker file belongs to."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > default_depth, F.array_join(F.slice(parts, 1, default_depth), "/")).otherwise("_root")

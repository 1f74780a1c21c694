"""Column functions on text, paths and identifiers. All but exact_metric_text stay inside Spark's own expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CHUNK_CHARS, OVERLAP_CHARS = 400, 50
#: Namespace of version-5 UUIDs for addresses (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: White space at the edges, Unicode's included.
EDGES = r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def normalise_source(text: Column) -> Column:
    """A parsed source before chunking: no NUL, single blanks, at most one empty line, stripped."""
    out = F.regexp_replace(text, r"\x00", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(out)


def chunk_starts(text: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Numbers of the fixed windows that cover the text; none for an empty one."""
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - F.lit(size)) / F.lit(float(size - overlap)))).cast("int")
    return F.when(F.length(text) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def chunk_at(text: Column, index: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    return F.substring(text, index * F.lit(size - overlap) + 1, F.lit(size))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(h.substr(17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("5"), h.substr(14, 3)), F.concat(variant, h.substr(19, 2)), h.substr(21, 12))


def point_id(chunk_id: Column) -> Column:
    return uuid5(F.concat(F.lit("rag-chunk:"), chunk_id))


def path_parts(path: Column) -> Column:
    """Folders and name of a path, backslashes taken as slashes, empty and '.' parts dropped."""
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))


def normalise_path(path: Column) -> Column:
    """Null where a part leads out ('..')."""
    return F.when(~F.array_contains(path_parts(path), ".."), F.array_join(path_parts(path), "/"))


def ancestors(folder: Column) -> Column:
    """A folder and the folders above it, from the top."""
    parts = path_parts(folder)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def extension(name: Column) -> Column:
    """Lower-case suffix with its dot; '' for names without one, dot files included."""
    return F.lower(F.regexp_extract(name, r"[^./](\.[^./]+)$", 1))


def metric_text(text: Column) -> Column:
    """Letters and digits only, lower-case, sharp s folded."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", "")


_NO_WORD = re.compile(r"[\W_]+")


@F.pandas_udf(StringType())
def exact_metric_text(text: pd.Series) -> pd.Series:
    """Letters and digits of the compatibility form, case-folded; '' for null. In Arrow batches, as Spark has no NFKC."""
    return text.fillna("").map(lambda t: _NO_WORD.sub("", unicodedata.normalize("NFKC", t).casefold()))


def file_path(relative: Column, folder: Column, name: Column, title: Column) -> Column:
    """The path shown for a retrieved file: the stored one, or its folder and name."""
    own = F.coalesce(F.nullif(name, F.lit("")), title)
    top = F.btrim(F.replace(F.coalesce(folder, F.lit("")), F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.coalesce(F.nullif(F.replace(relative, F.lit("\\"), F.lit("/")), F.lit("")), F.when(top != "", F.concat(top, F.lit("/"), own)).otherwise(own))


def cosine(a: Column, b: Column, strict: bool = False) -> Column:
    """Cosine of two float arrays in double precision, between -1 and 1. For vectors that are empty, of different sizes or of length zero it is null, or an error if strict."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fault = lambda why: F.raise_error(F.lit(why)).cast("double") if strict else F.lit(None).cast("double")
    out = F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0), fault("vectors must have one size, above 0"))
    return out.when(size == 0, fault("vectors must not be zero")).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def semantic_score(answer: Column, expected: Column, answer_vector: Column, expected_vector: Column) -> Column:
    """100 times the cosine of two texts' vectors, 0 at least, to two digits. A blank answer scores 0; a blank expectation is an error."""
    score = F.round(F.lit(100.0) * F.greatest(F.lit(0.0), cosine(answer_vector, expected_vector, strict=True)), 2)
    blank = lambda t: F.coalesce(strip(t), F.lit("")) == ""
    return F.when(blank(expected), F.raise_error(F.lit("the expected answer is blank")).cast("double")).when(blank(answer), F.lit(0.0)).otherwise(score)


def iso_time(at: Column) -> Column:
    """ISO 8601 in UTC, with microseconds where there are any; now for null."""
    at = F.coalesce(at, F.current_timestamp())
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(at, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(at, "SSSSSS"))).otherwise(""), F.lit("+00:00"))


#: Code, where nothing is changed.
CODE = r"(?s)(```.*?```|~~~.*?~~~|`[^`\n]*`)"
# Commands that make what stands between round brackets a formula.
COMMANDS = "frac dfrac tfrac sqrt Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi varpi rho varrho sigma varsigma tau upsilon phi varphi chi psi omega sin cos tan cot sec csc log ln exp lim sum prod int partial nabla infty times cdot pm mp leq geq neq approx equiv begin left right".split()


def dollar_formulas(text: Column) -> Column:
    """Formulas between backslashed brackets, and between round ones with a command in them, get dollar signs; those of square brackets lines of their own. Code stays as it is."""
    code = F.concat(F.regexp_extract_all(text, F.lit(CODE), F.lit(1)), F.array(F.lit("")))
    steps = ((r"(?s)\\\[\s*(.*?)\s*\\\]", "\n\\$\\$\n$1\n\\$\\$\n"), (r"\\\([^\S\n]*([^\n]*?)[^\S\n]*\\\)", r"\$$1\$"), (rf"\((?=[^()\n]*\\(?:{'|'.join(COMMANDS)})\b)[^\S\n]*([^()\n]+?)[^\S\n]*\)", r"\$$1\$"))

    def marked(t: Column) -> Column:
        for pattern, by in steps:
            t = F.regexp_replace(t, pattern, by)
        return t

    both = F.zip_with(F.transform(F.split(text, CODE, -1), marked), code, lambda t, c: F.concat(F.coalesce(t, F.lit("")), F.coalesce(c, F.lit(""))))
    return F.array_join(both, "")

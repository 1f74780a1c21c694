"""Secret scan: fixed patterns, and a linear-chain conditional random field over the words around suspicious tokens.

Tokens are runs of non-space characters. The field tags them as secret begin (B), inside (I) or outside (O) from their shape, their neighbours and features of the file, and is decoded by Viterbi. It is trained here, on sentences that a seeded generator writes with secrets of many kinds, of letters alone and of letters and marks too, and with what looks like them (addresses, numbers, dates, hosts, names, words after a keyword). Every token is judged but a plain one (under 20 characters, none of them in TRIGGER, and no mark between its letters as in MARKED) that no cue is near: no keyword in the two tokens before it or the one after, no = or : at the end of the token before. Such a token is a word like any other and always outside, in training too. As the chain is linear, the runs of judged tokens between those can then be decoded by themselves, with the same tags as the whole text would get.

Spans of the patterns always stay; a tagged run adds one where no pattern's span overlaps it. A null or empty text has no spans. Texts are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import documents

# Kinds in order, with patterns and the least length of what is measured.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
CUE = re.compile("passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the patterns' spans, in code points."""
    out = []
    if ("=" in text or ":" in text) and CUE.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


TRIGGER = re.compile(r"[0-9_=+/@]")
#: Marks between two letters that words don't have there.
MARKED = re.compile(r"(?<=[^\W\d_])[!#$%&*^~?\\|]+(?=[^\W\d_])")
LONG = re.compile(r"(?<!\S)\S{20,}")
#: What each of KEYWORDS holds, and the end of a token that assigns.
NEAR = re.compile(r"passw|passphrase|pwd|secret|token|key|bearer|credential|auth|private|[=:](?!\S)", re.IGNORECASE)
TOKEN = re.compile(r"\S+")
SPACE = re.compile(r"\s")
EDGES = "\"'`()<>[]{},;:!?#$%&*|.=~"
KEYWORDS = {"password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "bearer", "credential", "credentials", "passphrase", "auth", "authorization", "access_key", "secret_key", "private"}
PREFIXES = ("akia", "ghp_", "gho_", "sk-", "sk_", "xox", "eyj", "aiza", "glpat-", "-----begin")
FEATURES = [
    "bias", "plain", "len<8", "len<16", "len<24", "len<40", "len>=40", "lower", "upper", "title", "digits", "alnum_mixed", "hex", "base64", "three_cases", "has_mark", "marked", "camel", "odd_cases", "consonants", "word_marks", "email", "url", "number", "entropy<2.5", "entropy<3.5", "entropy>=3.5",
    "prefix", "assigned", "keyword", "prev_keyword", "prev2_keyword", "next_keyword", "prev_assigns", "prev_plain", "next_plain", "file_cues", "file_code", "file_numbers", "first", "last",
]
F_AT = {f: i for i, f in enumerate(FEATURES)}
TAGS = "BIO"
CUES = [F_AT[f] for f in ("prev_keyword", "prev2_keyword", "next_keyword", "prev_assigns")]
#: Score of tagging a token that isn't judged as part of a secret.
NEVER = -50.0


def _core(token: str) -> tuple[int, int]:
    """Where a token's inner part begins and ends, without quotes and marks at its edges, and after an assignment."""
    a, b = 0, len(token)
    while b > a and token[b - 1] in EDGES:
        b -= 1
    while a < b and token[a] in EDGES:
        a += 1
    m = re.match(r"[A-Za-z_]{2,30}[\"']?[:=]+[\"']?(?=[^/\s])", token[a:b])
    return (a + m.end() if m and a + m.end() < b else a), b


def _word(token: str) -> str:
    return token.strip(EDGES + "-").lower()


def is_plain(token: str) -> bool:
    return len(token) < 20 and not TRIGGER.search(token) and not MARKED.search(token)


def own_features(token: str) -> list[int]:
    a, b = _core(token)
    core = token[a:b]
    n = len(core)
    out = ["bias", *(["plain"] if is_plain(token) else []), "len<8" if n < 8 else "len<16" if n < 16 else "len<24" if n < 24 else "len<40" if n < 40 else "len>=40"]
    lower, upper, digit = (any(f(c) for c in core) for f in (str.islower, str.isupper, str.isdigit))
    if core.isalpha():
        out += ["lower"] if core.islower() else ["upper"] if core.isupper() else ["title"] if core[1:].islower() else []
    elif core.isdigit():
        out.append("digits")
    if digit and (lower or upper):
        out.append("alnum_mixed")
        if lower and upper:
            out.append("three_cases")
    if re.fullmatch(r"[0-9a-fA-F]{8,}", core) and digit and (lower or upper):
        out.append("hex")
    if re.fullmatch(r"[A-Za-z0-9+/=_.-]{8,}", core) and digit:
        out.append("base64")
    if not core.isalnum():
        out.append("has_mark")
        if re.fullmatch(r"[^\W\d_]+(?:['\u2019.-][^\W\d_]+)+", core):
            out.append("word_marks")
        elif MARKED.search(core):
            out.append("marked")
    if re.search("[a-z][A-Z]", core):
        out.append("camel")
    if core.isalpha() and re.search("[A-Z][a-z]?[A-Z]", core) and lower:
        out.append("odd_cases")
    if re.search("[bcdfghjklmnpqrstvwxz]{5}", core, re.IGNORECASE):
        out.append("consonants")
    if re.fullmatch(r"[^@\s]+@[\w.-]+\.\w+", core):
        out.append("email")
    if re.match(r"(https?://|www\.|/\w)", core) or re.fullmatch(r"[\w-]+(\.[\w-]+)+(/\S*)?", core) and not digit:
        out.append("url")
    if re.fullmatch(r"[-+()\d.,:/%xX]+", core):
        out.append("number")
    if n:
        h = -sum(c / n * math.log2(c / n) for c in Counter(core).values())
        out.append("entropy<2.5" if h < 2.5 else "entropy<3.5" if h < 3.5 else "entropy>=3.5")
    if core.lower().startswith(PREFIXES):
        out.append("prefix")
    if a and any(c in token[:a] for c in ":="):
        out.append("assigned")
    if _word(token[: a or None]) in KEYWORDS:
        out.append("keyword")
    return [F_AT[f] for f in out]


def file_features(text: str) -> list[int]:
    out = []
    if CUE.search(text):
        out.append(F_AT["file_cues"])
    n = max(1, len(text))
    if 50 * (text.count("{") + text.count("}") + text.count(";") + text.count("=")) > n:
        out.append(F_AT["file_code"])
    if sum(map(text.count, "0123456789")) * 20 > n:
        out.append(F_AT["file_numbers"])
    return out


def matrix(tokens: list[str], file: list[int], before: list[str], after: list[str]) -> np.ndarray:
    """A row of features for each token; before and after: up to two and one neighbours outside."""
    x = np.zeros((len(tokens), len(FEATURES)), np.float64)
    every = [*(["", ""] + before)[-2:], *tokens, *(after + [""])[:1]]
    words = [_word(t) for t in every]
    for i, t in enumerate(tokens):
        x[i, own_features(t)] = 1
        x[i, file] = 1
        at = i + 2
        prev, after_it = every[at - 1], every[at + 1]
        x[i, F_AT["prev_keyword"]] = words[at - 1] in KEYWORDS
        x[i, F_AT["prev2_keyword"]] = words[at - 2] in KEYWORDS
        x[i, F_AT["next_keyword"]] = words[at + 1] in KEYWORDS
        x[i, F_AT["prev_assigns"]] = prev[-1:] in ("=", ":")
        x[i, F_AT["prev_plain"]] = bool(prev) and is_plain(prev)
        x[i, F_AT["next_plain"]] = bool(after_it) and is_plain(after_it)
        x[i, F_AT["first"]] = not prev
        x[i, F_AT["last"]] = not after_it
    return x


def unjudged(x: np.ndarray) -> np.ndarray:
    """Which rows of features are of plain tokens without a cue."""
    return (x[..., F_AT["plain"]] > 0) & ~(x[..., CUES] > 0).any(-1)


class Field:
    """Weights: features by tags, and tag pairs."""

    def __init__(self, w: np.ndarray, pair: np.ndarray):
        self.w, self.pair = w, pair

    def decode(self, x: np.ndarray) -> str:
        """The likeliest tags of one run, which stands between tokens tagged O."""
        s = x @ self.w
        s[unjudged(x), :2] = NEVER
        score, back = s[0] + self.pair[2], []
        for row in s[1:]:
            ways = score[:, None] + self.pair
            back.append(ways.argmax(0))
            score = ways.max(0) + row
        tags = [int((score + self.pair[:, 2]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return "".join(TAGS[t] for t in reversed(tags))


def training_sentences(n: int, seed: int) -> list[tuple[list[str], str]]:
    """Invented sentences with their tags."""
    import random

    r = random.Random(seed)
    syllables = ["an", "er", "the", "on", "ti", "re", "ed", "la", "ou", "ment", "ci", "en", "sch", "ge", "ra", "do"]
    upper, low, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def some(chars: str, a: int, b: int) -> str:
        return "".join(r.choice(chars) for _ in range(r.randint(a, b)))

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        return r.choice([w, w, w, w.capitalize(), w + r.choice(",.;:!?"), w + r.choice(["###", "$$$", "&&&", "***", "%%%"]), w.upper() + "!!", "|"])

    def secret() -> str:
        return r.choice([
            lambda: some("0123456789abcdef", 20, 64), lambda: "AKIA" + some(upper + digits, 16, 16), lambda: some(upper + low + digits + "+/", 32, 44) + r.choice(["", "="]),
            lambda: "ghp_" + some(upper + low + digits, 36, 36), lambda: "sk-" + some(upper + low + digits, 24, 48), lambda: "xoxb-" + some(digits, 10, 12) + "-" + some(upper + low + digits, 24, 24),
            lambda: "eyJ" + some(upper + low + digits, 20, 40) + "." + some(upper + low + digits + "_-", 30, 60), lambda: some(upper + low + digits + "_-", 12, 24) + r.choice(digits),
        ])()

    def lettered() -> str:
        """Without digits: words run together, letters of mixed case or few vowels, and letters and marks."""
        parts = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(2, 4))]
        marks = "!#$%&*^~?"
        return r.choice([
            lambda: "".join(p.capitalize() for p in parts), lambda: parts[0] + "".join(p.capitalize() for p in parts[1:]), lambda: some(upper + low, 8, 19), lambda: some("bcdfghjklmnpqrstvwxz", 8, 19),
            lambda: some(upper + low, 2, 6) + r.choice(marks) + some(upper + low, 3, 8), lambda: r.choice(marks).join(r.choice([p, p.capitalize()]) for p in parts),
            lambda: parts[0].capitalize()[:2] + r.choice(marks) + parts[0] + r.choice("$!-.") + "-".join(p.capitalize() for p in parts[1:]),
        ])()

    def innocent() -> str:
        return r.choice([
            lambda: f"{some(low, 3, 8)}.{some(digits, 1, 2)}@mail{some(digits, 1, 1)}.example.com", lambda: f"https://{some(low, 4, 9)}.example.org/{some(low, 2, 6)}/{some(digits, 1, 4)}",
            lambda: some(digits, 1, 4), lambda: some(digits, 13, 16), lambda: f"({some(digits, 3, 3)})", lambda: f"555-{some(digits, 4, 4)}", lambda: ".".join(some(digits, 1, 3) for _ in range(4)),
            lambda: f"20{some(digits, 2, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", lambda: f"{some(digits, 1, 3)}.{some(digits, 1, 2)}%", lambda: f"{word().strip('.,;:!?')}_{some(low, 3, 7)}", lambda: f"/{some(low, 3, 6)}/{some(low, 3, 8)}.{some(low, 2, 3)}",
            lambda: "".join(r.choice(syllables) for _ in range(12)), lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}", lambda: f"{some(low, 2, 5)}={some(low, 2, 6)}", lambda: f"+{some(digits, 9, 12)}", lambda: f"{some(upper, 2, 3)}-{some(digits, 2, 6)}", lambda: "and/or",
        ])()

    out = []
    for _ in range(n):
        tokens, tags = [], ""
        for _ in range(r.randint(2, 5)):
            for _ in range(r.randint(0, 4)):
                tokens.append(word())
                tags += "O"
            kind = r.random()
            if kind < 0.35:
                form = r.random()
                s, key, quote = lettered() if form < 0.8 and r.random() < 0.4 else secret(), r.choice(sorted(KEYWORDS)), r.choice(["", "", '"', "'"])
                key = r.choice([key, key.upper(), key.capitalize()])
                if form < 0.35:
                    tokens += [key, r.choice(["=", ":", "is"]), f"{quote}{s}{quote}{r.choice(['', '', '.', '###', ';'])}"]
                    tags += "OOB"
                elif form < 0.6:
                    tokens += [f"{key}{r.choice(['=', ':'])}{quote}{s}{quote}"]
                    tags += "B"
                elif form < 0.8:
                    tokens += [f"{key}:", f"{quote}{s}{quote}"]
                    tags += "OB"
                elif form < 0.9:
                    tokens += [key, "=", quote + s, some(upper + low + digits, 16, 24) + quote]
                    tags += "OOBI"
                else:
                    tokens += [s]
                    tags += "B"
            elif kind < 0.9:
                tokens.append(innocent() + r.choice(["", "", ",", ".", "###"]))
                tags += "O"
            elif kind < 0.95:
                # a keyword is no secret, nor are the words after it
                tokens += [r.choice(sorted(KEYWORDS)), r.choice(["is", "=", ":", "of"]), word()]
                tags += "OOO"
            elif kind < 0.98:
                w = r.choice(["", "-", "'"]).join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 2)))
                tokens += [r.choice(sorted(KEYWORDS)), r.choice([w, w.capitalize(), w.upper()]), word()]
                tags += "OOO"
        for _ in range(r.randint(1, 3)):
            tokens.append(word())
            tags += "O"
        out.append((tokens, tags))
    return out


def train(n: int = 500, seed: int = 11, steps: int = 100, ridge: float = 1e-3) -> Field:
    """Maximum conditional likelihood by gradient steps on all sentences at once; forward and backward sums go over places."""
    data = training_sentences(n, seed)
    longest, d = max(len(t) for t, _ in data), len(FEATURES)
    x, y, there = np.zeros((n, longest, d)), np.full((n, longest), 2), np.zeros((n, longest), bool)
    for i, (tokens, tags) in enumerate(data):
        x[i, : len(tokens)] = matrix(tokens, file_features(" ".join(tokens)), [], [])
        y[i, : len(tokens)] = np.where(unjudged(x[i, : len(tokens)]), 2, [TAGS.index(t) for t in tags])
        there[i, : len(tokens)] = True
    size = d * 3 + 9
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    flat = x.reshape(-1, d)
    outside = unjudged(x)
    truth = np.eye(3)[y] * there[:, :, None]
    real_pairs = np.einsum("nla,nlb->ab", truth[:, :-1], truth[:, 1:])
    for step in range(1, steps + 1):
        w, pair = theta[: d * 3].reshape(d, 3), theta[d * 3 :].reshape(3, 3)
        s = (flat @ w).reshape(n, longest, 3)
        s[outside, :2] = NEVER
        e, p = np.exp(s), np.exp(pair)
        up, down = np.zeros_like(e), np.zeros_like(e)
        up[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for i in range(1, longest):
            up[:, i] = (up[:, i - 1] @ p) * e[:, i]
            up[:, i] /= up[:, i].sum(1, keepdims=True)
        down[:, -1] = 1
        for i in range(longest - 2, -1, -1):
            down[:, i] = np.where(there[:, i + 1, None], (down[:, i + 1] * e[:, i + 1]) @ p.T, 1)
            down[:, i] /= down[:, i].sum(1, keepdims=True)
        tag = up * down
        tag = tag / tag.sum(2, keepdims=True) * there[:, :, None]
        both = up[:, :-1, :, None] * p * (e * down)[:, 1:, None, :]
        both = both / both.sum((2, 3), keepdims=True) * there[:, 1:, None, None]
        g = np.concatenate([(flat.T @ (truth - tag).reshape(-1, 3)).ravel(), (real_pairs - both.sum((0, 1))).ravel()]) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.15 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[: d * 3].reshape(d, 3), theta[d * 3 :].reshape(3, 3))


def _token_at(text: str, i: int) -> tuple[int, int]:
    """The token that the character at i is in."""
    a = i
    while a and not text[a - 1].isspace():
        a -= 1
    gap = SPACE.search(text, i)
    return a, gap.start() if gap else len(text)


def _tokens_before(text: str, end: int, most: int = 2) -> list[str]:
    """The last tokens before a place, however far off."""
    out = []
    while len(out) < most:
        while end and text[end - 1].isspace():
            end -= 1
        if not end:
            break
        a = _token_at(text, end - 1)[0]
        out.insert(0, text[a:end])
        end = a
    return out


def field_spans(text: str, field: Field, every: bool = False) -> list[tuple[int, int]]:
    """Spans of tagged runs. every: decodes the text whole, for comparison."""
    runs: list[list[tuple[int, int]]] = []
    if every:
        tokens = [m.span() for m in TOKEN.finditer(text)]
        runs = [tokens] if tokens else []
    else:
        at = {}
        end = -1
        for m in TRIGGER.finditer(text):
            if m.start() < end:
                continue
            a, end = _token_at(text, m.start())
            at[a] = end
        for m in LONG.finditer(text):
            at[m.start()] = m.end()
        end = -1
        for m in MARKED.finditer(text):
            if m.start() >= end:
                a, end = _token_at(text, m.start())
                at[a] = end
        end = -1
        for m in NEAR.finditer(text):
            if m.start() < end:
                continue
            a, end = _token_at(text, m.start())
            keyword = _word(text[a:end]) in KEYWORDS
            if not keyword and text[end - 1] not in "=:":
                continue
            after = TOKEN.search(text, end)
            if after:
                at[after.start()] = after.end()
            if keyword:
                after = after and TOKEN.search(text, after.end())
                if after:
                    at[after.start()] = after.end()
                b = a
                while b and text[b - 1].isspace():
                    b -= 1
                if b:
                    at[_token_at(text, b - 1)[0]] = b
        for a in sorted(at):
            if runs and not text[runs[-1][-1][1] : a].strip():
                runs[-1].append((a, at[a]))
            else:
                runs.append([(a, at[a])])
    out = []
    file = file_features(text) if runs else []
    for run in runs:
        after = TOKEN.search(text, run[-1][1])
        tags = field.decode(matrix([text[a:b] for a, b in run], file, _tokens_before(text, run[0][0]), [after[0]] if after else []))
        for i, t in enumerate(tags):
            a, b = run[i]
            lo, hi = _core(text[a:b])
            if t == "B" or t == "I" and (not out or i == 0 or tags[i - 1] == "O"):
                out.append((a + lo, a + hi))
            elif t == "I":
                out[-1] = (out[-1][0], a + hi)
    return [s for s in out if s[1] > s[0]]


def all_spans(text: str, field: Field, every: bool = False) -> list[tuple[int, int, str]]:
    base = pattern_spans(text)
    added = [(a, b, "crf") for a, b in field_spans(text, field, every) if not any(a < e and s < b for s, e, _ in base)]
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


OUT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(df: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """Replaces the text by counts of the patterns' spans, their digest, and all spans. Columns of those names are replaced."""
    field = field or train()
    names = [x.split()[0] for x in OUT.split(", ")]
    own = [c for c in df.columns if c == text or c not in names]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(text):
                spans = all_spans(value.as_py() or "", field)
                base = [s for s in spans if s[2] != "crf"]
                kinds = Counter(s[2] for s in base)
                out.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own if c != text], *columns], [*[c for c in own if c != text], *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in own and f.name != text] + [OUT])
    return df.select(*[f"`{c}`" for c in own]).mapInArrow(scan, schema)


def redact(text: str | None, field: Field, by: str = "[SECRET]") -> str | None:
    """The text with every span replaced; overlapping ones once."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in all_spans(text, field):
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join(out) + text[at:]


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir, "doc_id", "text"))

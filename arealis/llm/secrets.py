"""Secret scanning: patterns propose candidates, a random forest on their shape and surroundings decides.

The forest is Spark MLlib's, trained on labelled findings. labelled_findings() makes a bounded, seeded set of
them; a team with findings of its own passes those.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that name secrets, words that stand beside what is none, and prefixes of known formats.
SECRET_WORDS = ["token", "secret", "passw", "pwd", "api_key", "apikey", "api-key", "access_key", "auth", "credential", "private_key", "client_secret", "bearer"]
OTHER_WORDS = ["example", "sample", "dummy", "placeholder", "changeme", "your_", "test", "fake", "sha", "md5", "commit", "checksum", "digest", "uuid", "revision", "hash", "etag", "integrity"]
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "AIza", "sk_live_", "rk_live_", "sk-", "eyJ", "npm_", "SG."]
#: Frequent English words, for the share of a candidate that they cover.
DICTIONARY = "the and that have for not with this from they will would there their what about which when make like time just know take people into year your good some could them than then look only come over think also back after work first well even want because these give most data name file list user value string number index table model class count error message default config server client request response example test page home path item type text size line code main base node tree left right next last key".split()

RUN = re.compile(r"[A-Za-z0-9_+/=\-.~]{16,}")
#: A name, a sign and what follows them: to the closing quote, or without one to the first blank, quote, comma or bracket.
ASSIGNED = re.compile(r"""(?<![\w.\-])([\w.\-]++)["'`]?+\s*+(?:=>|:=|=|:)\s*+(?:"((?:[^"\\\r\n]|\\.){6,})"|'((?:[^'\\\r\n]|\\.){6,})'|`([^`\r\n]{6,})`|["'`]?([^\s"'`<>,;]{6,}))""")
NAMED = re.compile(r"(?i)token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|(?:^|[_.\-])pass(?:$|[_.\-])")
#: The password of a user in an address.
IN_ADDRESS = re.compile(r"(?i)(?<![a-z0-9+.\-])[a-z][a-z0-9+.\-]*+://[^\s/:@]*+:([^\s/@]{3,})@")
#: Letters of both cases by turns, as in no word or name.
WORDLESS = re.compile(r"[a-z][A-Z]+[a-z][A-Z]+[a-z]*[A-Z]")
BEARER = re.compile(r"(?i)\bbearer\s{1,3}([A-Za-z0-9._~+/\-]{16,}=*)")
#: Begin and end lines of private keys, PEM and PGP.
KEY_LINE = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
#: What can follow a begin line that has no end line: headers and lines of base64, then a shorter last line. Line ends may be escaped.
KEY_BODY = re.compile(r"""(?:(?:\\[nrt]|[\s"'`,|>#*])*+(?:[A-Za-z][A-Za-z0-9-]*+:[ \t][^\r\n\\]*+(?=[\r\n\\])|[A-Za-z0-9+/]{16,}+={0,2}))++(?:(?:\\[nr]|[\r\n])++[ \t]*+=?[A-Za-z0-9+/]{1,15}={0,2}(?=["'`\\\r\n]|\Z))*+""")
_WORD = re.compile(r"[a-z]{3,}")
AROUND = 48

FEATURES = ["length", "digits", "upper", "lower", "signs", "distinct", "entropy", "transitions", "covered", "hex", "uuid", "prefix", "in_path", "extension", "secret_word", "other_word", "assigned", "quoted", "inside_other", "key_block", "address", "blanks", "sentence"]


def _transitions() -> dict[str, float]:
    """Log shares of letter pairs in the dictionary, against pairs drawn evenly."""
    counts: dict[str, int] = {}
    for w in DICTIONARY:
        for a, b in zip(w, w[1:]):
            counts[a + b] = counts.get(a + b, 0) + 1
    total = sum(counts.values())
    return {k: math.log(n / total * 676) for k, n in counts.items()}


PAIRS = _transitions()


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Private keys from the begin line to the end line of the same name, over any characters and at any length.

    Without such a line before the next begin line, a block reaches as far as headers and base64 go; a begin line
    that nothing of the kind follows is none.
    """
    lines = list(KEY_LINE.finditer(text))
    for i, m in enumerate(lines):
        if m[1] == "END":
            continue
        for end in lines[i + 1 :]:
            if end[1] == "BEGIN":
                end = None
                break
            if end[2] == m[2]:
                break
        else:
            end = None
        if end is None:
            end = KEY_BODY.match(text, m.end())
        if end is not None:
            yield m.start(), end.end()


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule) in order of start, none within another."""
    found = [(a, b, "key_block") for a, b in key_blocks(text)] if "-----BEGIN " in text else []
    low = text.lower()
    if any(w in low for w in ("token", "secret", "pass", "pwd", "key", "auth", "credential")):
        found += [(*m.span(m.lastindex), "assigned") for m in ASSIGNED.finditer(text) if NAMED.search(m[1])]
    if "://" in low:
        found += [(m.start(1), m.end(1), "address") for m in IN_ADDRESS.finditer(text)]
    if "bearer" in low:
        found += [(m.start(1), m.end(1), "bearer") for m in BEARER.finditer(text)]
    for m in RUN.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".=-/":
            b -= 1
        run = text[a:b]
        if len(run) >= 16 and any(c.isalpha() for c in run) and (any(c.isdigit() for c in run) or WORDLESS.search(run)):
            found.append((a, b, "run"))
    out: list[tuple[int, int, str]] = []
    for a, b, rule in sorted(found, key=lambda f: (f[0], -f[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, rule))
        elif out[-1][2] == "run" and rule != "run":  # what is named or framed goes before a bare run, to whose end it reaches
            out[-1] = (a, max(b, out[-1][1]), rule)
        elif rule == "key_block" and b > out[-1][1]:  # begins within another
            out[-1] = (out[-1][0], b, rule)
    return out


def beside(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands before and after, some AROUND characters of whole words each."""
    a, b = max(0, start - AROUND), min(len(text), end + AROUND)
    while a > 0 and start - a < 4 * AROUND and not text[a - 1].isspace():
        a -= 1
    while b < len(text) and b - end < 4 * AROUND and not text[b].isspace():
        b += 1
    return text[a:start], text[end:b]


def features(text: str, start: int, end: int, rule: str, path: str) -> list[float]:
    s = text[start:end]
    before, after = beside(text, start, end)
    n, low, near, ahead = len(s), s.lower(), (before + " " + after).lower(), before.rstrip("\"'` ")
    counts: dict[str, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    letters = [a + b for a, b in zip(low, low[1:]) if a.isalpha() and b.isalpha()]
    covered = sum(len(m) for m in _WORD.findall(low) for w in [m] if w in DICTIONARY or any(d in w for d in DICTIONARY if len(d) > 3))
    return [
        math.log2(n),
        sum(c.isdigit() for c in s) / n,
        sum(c.isupper() for c in s) / n,
        sum(c.islower() for c in s) / n,
        sum(not c.isalnum() for c in s) / n,
        len(counts) / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(PAIRS.get(p, -2.0) for p in letters) / max(len(letters), 1),
        covered / n,
        float(all(c in "0123456789abcdef" for c in low)),
        float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        float(any(s.startswith(p) for p in PREFIXES)),
        float(s.count("/") + before[-8:].count("/") + ("http" in near) > 1),
        float(bool(re.search(r"\.[a-z]{2,4}$", low)) or bool(re.search(r"\.(md|txt|lock|sum|html?|css|min\.js)$", path.lower()))),
        float(sum(w in before.lower() for w in SECRET_WORDS)),
        float(sum(w in near for w in OTHER_WORDS)),
        float(ahead.endswith(("=", ":", "=>")) or rule == "assigned"),
        float(before[-1:] in "\"'`" and before[-1:] != ""),
        float(sum(w in low for w in OTHER_WORDS) + ("xxxx" in low)),
        float(rule == "key_block"),
        float(rule == "address"),
        float(s.count(" ")),
        float(s[:1].isupper() and s[-1:] in ".!?:"),
    ]


def labelled_findings(rows: int = 4000, seed: int = 17) -> list[tuple[str, int, int, str, str, float]]:
    """(text, start, end, rule, path, label): rows findings with secrets and look-alikes in varied surroundings."""
    rng, out = random.Random(seed), []
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    syllables = "an er on re in ti es en th ou le de ra si ma no ta lo che ver".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    words = lambda n: " ".join(word() for _ in range(n))

    def key_block(secret: bool) -> str:
        name = rng.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK"])
        begin, end = f"-----BEGIN {name}-----", f"-----END {name}-----"
        if not secret:
            body = rng.choice([words(rng.randint(1, 12)), "...", "<your key here>", "YOUR_PRIVATE_KEY", "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "[REDACTED]", "base64 data", f'" + {word()} + "', f'") and {word()}.endswith("', f"\\|{word()}.*"])
            return begin + rng.choice(["\n", " ", "", "\\n"]) + body + rng.choice(["\n", " ", "", "\\n"]) + end
        line = rng.choice(["\n", "\n", "\r\n", "\\n"])
        heads = rng.choice([[], [], ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-256-CBC," + hexes(32).upper(), ""], ["Version: GnuPG v2", ""]])
        body = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=64)) for _ in range(rng.choice([1, 2, 3, 13, 26, 51]))]
        return line.join([begin, *heads, *body, mixed(rng.randint(17, 60)) + "=", *([end] if rng.random() < 0.8 else [])])

    while len(out) < rows:
        names = rng.choice(["token", "api_key", "secret", "password", "access_token", "auth_token", "client_secret", "credential", "AWS_SECRET_ACCESS_KEY", "TOKEN"])
        equal, quote = rng.choice([" = ", "=", ": ", " := "]), rng.choice(["\"", "'", ""])
        path = rng.choice(["", "src0", "conf/settings.py", "app/.env", "docs/readme.md", "yarn.lock"])
        kind = rng.randint(0, 17)
        if kind <= 2:
            value, label, lead = rng.choice([hexes(40), hexes(32), hexes(64), mixed(rng.randint(20, 48))]), 1.0, f"{names}{equal}{quote}"
        elif kind == 3:
            value, label, lead, quote = rng.choice(["AKIA" + mixed(16).upper(), "ghp_" + mixed(36), "xoxb-" + hexes(12) + "-" + mixed(24), "AIza" + mixed(35), "sk_live_" + mixed(24)]), 1.0, rng.choice(["", f"{names}{equal}", words(1) + " "]), ""
        elif kind == 4:
            value, label, lead, quote = "eyJ" + mixed(30) + "." + mixed(60) + "." + mixed(40), 1.0, rng.choice(["Authorization: Bearer ", f"{names}{equal}"]), ""
        elif kind == 5:
            value, label, lead = word()[:5] + rng.choice("!@#_-") + mixed(rng.randint(6, 12)), 1.0, f"password{equal}{quote}"
        elif kind == 6:
            value, label, lead, quote = hexes(rng.choice([32, 40, 64])), 0.0, rng.choice(["commit ", "sha256: ", "md5 ", "revision ", "checksum=", "etag: ", "integrity sha512-"]), ""
        elif kind == 7:
            value, label, lead, quote = "-".join([hexes(8), hexes(4), hexes(4), hexes(4), hexes(12)]), 0.0, rng.choice(["id ", "uuid: ", "", "request "]), ""
        elif kind == 8:
            value, label, lead = rng.choice(["your_token_here_0000", "example-token-1234567", "xxxxxxxxxxxxxxxx0000", "changeme12345678", "test_secret_value_1", "<placeholder-key-01>"]).strip("<>"), 0.0, f"{names}{equal}{quote}"
        elif kind == 9:
            value, label, lead, quote = f"{word()}/{word()}/{word()}{rng.randint(1, 99)}/{word()}.{rng.choice(['html', 'js', 'py', 'txt'])}", 0.0, rng.choice(["http://", "see ", "/"]), ""
        elif kind == 10:
            value, label, lead, quote = f"{word()}_{word()}{rng.randint(1, 9)}_{word()}_{word()}", 0.0, rng.choice(["def ", "", "class "]), ""
        elif kind == 14:  # quoted words: a pass phrase, or a sentence about one
            label, quote = float(rng.random() < 0.6), rng.choice(["\"", "'"])
            value = words(rng.randint(3, 7)) if label else words(rng.randint(3, 9)).capitalize() + "."
            lead = f"{rng.choice(['password', 'db_password', 'passphrase', 'secret'])}{'' if label else rng.choice(['_hint', '_help', '_text', '_label'])}{equal}{quote}"
        elif kind == 15:
            value, label, lead, quote = mixed(rng.randint(6, 20)) if rng.random() < 0.7 else word() + rng.choice("!_-") + word(), 1.0, f"{rng.choice(['postgres', 'https', 'redis', 'amqp', 'mysql'])}://{word()}:", "@" + rng.choice(["localhost:5432/db", "host/x", f"{word()}.example.org"])
        elif kind == 16:  # letters only
            value, label, lead, quote = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=rng.randint(20, 48))), 1.0, rng.choice(["", f"{names}{equal}"]), ""
        elif kind == 17:  # names of many words
            value, label, lead, quote = rng.choice(["".join(word().capitalize() for _ in range(rng.randint(3, 7))), "-".join(word() for _ in range(rng.randint(4, 7))), ".".join(word() for _ in range(rng.randint(4, 6)))]), 0.0, rng.choice(["", "class ", "see ", "import "]), ""
        elif kind in (12, 13):
            value, label, lead = key_block(kind == 12), float(kind == 12), rng.choice(["", "\n", f"{names}{equal}{quote}"])
            quote = quote if lead.strip() else ""
        else:
            value, label, lead, quote = rng.choice([f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", f"{rng.randint(10**15, 10**16)}a", "2024-01-0" + str(rng.randint(1, 9)) + "T10:00:00Z", "-".join(word() for _ in range(4)) + str(rng.randint(1, 9))]), 0.0, rng.choice(["", "on ", "mail "]), ""
        head = words(rng.randint(0, 8)) + " "
        text = head + lead + value + quote + " " + words(rng.randint(0, 8))
        start = len(head) + len(lead)
        rule = "key_block" if kind in (12, 13) else "address" if kind == 15 else "assigned" if label and kind <= 2 or kind == 14 else "run"
        out.append((text, start, start + len(value), rule, path, label))
    return out


def train(spark: SparkSession, findings: list[tuple[str, int, int, str, str, float]] | None = None, trees: int = 40, depth: int = 8) -> RandomForestClassificationModel:
    """A forest from labelled findings, by default labelled_findings(): a bounded set that passes through the driver."""
    rows = [(features(t, a, b, rule, path), label) for t, a, b, rule, path, label in (labelled_findings() if findings is None else findings)]
    data = spark.createDataFrame(rows, "f array<double>, label double").coalesce(1).select(array_to_vector("f").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, featureSubsetStrategy="sqrt").fit(data)


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row per candidate: doc_id, text_key, start, end (code points), rule, value_sha256, score, is_secret.

    Whole texts are scanned; null and empty ones have no candidates. Of overlapping candidates one
    counts: what is assigned or framed, then the one that begins first, then the longest. path_col, if given, names the text's file for the forest. Rows that
    repeat an id are scanned each; text_key, a hash of the text, tells them apart. An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"), (F.col(path_col) if path_col else F.lit("")).cast("string").alias("path"))
    schema = f"id {dict(source.dtypes)['id']}, text_key long, start int, end int, rule string, value_sha256 string, f array<double>"

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, key, path in batch.itertuples(index=False):
                for a, b, rule in candidates(text or ""):
                    out.append((i, key, a, b, rule, hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest(), features(text, a, b, rule, path or "")))
            yield pd.DataFrame(out, columns=["id", "text_key", "start", "end", "rule", "value_sha256", "f"])

    found = source.mapInPandas(find, schema).withColumn("features", array_to_vector("f"))
    score = vector_to_array("probability")[1]
    return model.transform(found).select(F.col("id").alias(id_col), "text_key", "start", "end", "rule", "value_sha256", score.alias("score"), (score >= threshold).alias("is_secret"))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each secret that scan() found replaced by mark; all rows stay, all columns as they are but the text."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # whatever columns are called
    spans = found.where("is_secret").select(F.col(f"`{id_col}`").alias("_id"), F.col("text_key").alias("_key"), F.struct("start", "end").alias("s")).distinct()
    spans = spans.groupBy("_id", "_key").agg(F.array_sort(F.collect_list("s")).alias("_spans"))  # of one text
    text = F.col(at[text_col])
    # from the last span to the first, so that earlier places stay right
    cleaned = F.aggregate(F.reverse("_spans"), text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit(mark), F.substring(t, s["end"] + 1, F.length(t))))
    rows = docs.select(*[F.col(f"`{c.replace('`', '``')}`").alias(n) for c, n in at.items()])
    joined = rows.join(spans, F.col("_id").eqNullSafe(F.col(at[id_col])) & (F.col("_key") == F.xxhash64(text)), "left")
    return joined.select(*[(F.when(F.col("_spans").isNull(), text).otherwise(cleaned) if c == text_col else F.col(n)).alias(c) for c, n in at.items()])

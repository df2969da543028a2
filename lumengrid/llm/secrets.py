"""Secret scans: candidates by character runs, a random forest against false positives.

A candidate is a run of token characters of at least `LEAST` bytes that is no plain word: with a digit, with a capital after a
small letter, with a sign that words lack, or of `LONG` bytes and more; a leading `name=` or `name:` belongs to the words before
it. Runs of letters alone, in one case or capitalised, are words: nothing but what stands before them can tell. What follows an asking word (password, key, token ...) is a candidate
whatever its characters and length, up to a quote or white space. The forest judges length, character classes and transitions, coverage
by dictionary words, path traits and the neighbouring words. It is trained by Spark's RandomForestClassifier on labelled
findings: a table (candidate, before, after, secret) with at most `FINDINGS` rows; `labelled_findings` makes one.
Its trees are small and fixed in number, and go to the tasks as nested tuples.

Null texts have no findings. Texts of any length are read whole; a run of any length is one candidate. Findings come in
the text's order and do not overlap. Repeated rows get equal results. An empty table gives an empty result. `redact`
keeps all columns of its input; a clashing column `findings` is replaced.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumengrid.llm.common import give_back, slices, table

LEAST, LONG = 6, 20
FINDINGS = 8000
TREES, DEPTH = 30, 8
MARK = "[SECRET]"
THRESHOLD = 0.5

TOKEN = np.zeros(256, bool)
TOKEN[[ord(c) for c in string.ascii_letters + string.digits + "_-+/=.~:@"]] = True
#: Digits, and token characters that plain words lack.
ODD = np.zeros(256, bool)
ODD[[ord(c) for c in string.digits + "_+=~"]] = True
NAME = re.compile(r"^[A-Za-z_.-]{2,24}[=:](?!//)")
ASKS = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "auth", "bearer", "credential", "credentials", "private")
DENIES = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "uuid", "guid", "id", "version", "build", "phone", "tel", "date", "isbn", "example", "placeholder", "revision", "digest")
#: An asking word, what parts it from its value, and the value.
ASKED = re.compile(rf"(?i:{'|'.join(sorted(ASKS, key=len, reverse=True))})[\"']?(?:\s*[:=]\s*|\s+)[\"']?([^\s\"']+)")
HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live", "xox", "AIza", "eyJ", "glpat-")
DICTIONARY = tuple("""about access account after again also another answer back base because become before begin between book bridge
build call change child city clear client close code color come common company config content control count country course
create data date default delete demo design detail development device different document down draft during early email
enter error event every example family field file final find first folder follow form from function game general give good
government great green group guide hand head help hold home house human image important index info information input issue
item keep kind know large last later layer learn left letter level life light like line link list little live local long
look machine main make market master matter message method might model module money month more morning most move much name
national need network never next night note nothing number object office open option order other output over package page
paper parent part people percent place plan play point post power present problem process product program project public
question quick read real record release remote report request result return right river room sample school score search
second section server service session several show side simple since size small social some sort source space special spring
staff stage stand start state station still story street strong student style summer system table take task team test text
that their them then there these thing think this those thought three through time title today together total town track
train tree true turn under until update upload user value version video view voice wait walk wall want water week welcome
west what when where which while white window winter with within without woman word work world would write year young your
changeme placeholder dummy fake none null xxxx""".split())
WORD = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)))


def shape(candidate: str, before: str, after: str) -> list[float]:
    """The features of a candidate with the words before and after it."""
    n = len(candidate)
    kinds = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "s" for c in candidate]
    share = [kinds.count(k) / n for k in "ulds"]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(n - 1, 1)
    counts = np.unique(list(candidate), return_counts=True)[1] / n
    entropy = float(-(counts * np.log2(counts)).sum())
    lower = candidate.lower()
    covered = sum(len(m) for m in WORD.findall(lower))
    vowels = sum(c in "aeiou" for c in lower) / n
    runs = re.findall(r"[a-z]+", lower)
    pairs = sum(a + b in PAIRS for r in runs for a, b in zip(r, r[1:], strict=False))
    hexes = all(c in string.hexdigits for c in candidate)
    words = re.findall(r"[a-z_0-9]+", before.lower())[-3:]
    return [
        math.log(n), *share, changes, entropy, covered / n, vowels, pairs / max(n - 1, 1), max(map(len, runs), default=0) / n,
        float(hexes), float(n in (32, 40, 64)), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", candidate))),
        float(candidate.count("/")), float("@" in candidate), float(candidate.count(".")), float(candidate.count("-") + candidate.count(":")), float(bool(re.search(r"\.[a-z]{2,4}$", lower))),
        float(any(w in ASKS for w in words)), float(any(w in DENIES for w in words)), float(before.rstrip(" \"'").endswith(("=", ":"))), float(after[:1] in ("\"", "'")), float(candidate.startswith(HEADS)), float(bool(re.fullmatch(r"[\d.:+-]+", candidate))),
    ]


#: Letter pairs that are common in words; of a random string few are.
PAIRS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split())


def labelled_findings(spark: SparkSession, n: int = 4000, seed: int = 11) -> DataFrame:
    """A table of labelled findings: drawn secrets, and strings that look like them, among words."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexes, b64, up = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567"
    syllable = lambda: r.choice("th er in an on re at en ti ou ha st nd ing ion le de ch qu eau ver".split())
    made_up = lambda: "".join(syllable() for _ in range(r.randint(1, 4)))
    words = lambda k: " ".join(r.choice(DICTIONARY) if r.random() < 0.3 else made_up() for _ in range(k))
    asks = lambda: r.choice(ASKS) + r.choice(["=", ": ", " = ", "=\"", " = \"", ": '", " "])
    secret = [
        lambda: (r.choice(["AKIA", "ASIA"]) + pick(up, 16), words(2) + " "),
        lambda: (pick(hexes, r.choice([16, 18, 20, 24, 32, 40, 48, 64])), words(1) + " " + asks()),
        lambda: (pick(b64, r.choice([20, 24, 32, 40, 44])), words(1) + " " + asks()),
        lambda: (r.choice(["ghp_", "gho_", "sk-", "sk_live_", "AIza", "glpat-", "xoxb-"]) + pick(string.ascii_letters + string.digits, r.randint(20, 40)), words(2) + " "),
        lambda: ("eyJ" + pick(b64, 30) + "." + pick(b64, 40) + "." + pick(b64, 30), words(1) + " "),
        lambda: (pick(string.ascii_letters + string.digits + "_-", r.randint(10, 20)), words(1) + " " + asks()),
    ]
    marks = "!#$%^&*?@"
    passphrase = lambda: "".join(made_up().capitalize() for _ in range(r.randint(2, 3)))
    told = lambda: words(1) + " " + r.choice(ASKS) + r.choice(["=", ": ", " = ", "=\"", ": '"])
    secret += [
        lambda: (pick(string.ascii_letters, r.randint(12, 19)), words(2) + " "),
        lambda: (passphrase(), told()),
        lambda: (pick(string.ascii_letters, r.randint(8, 19)), told()),
        lambda: (pick(string.ascii_letters + string.digits + marks, r.randint(6, 20)) + r.choice(marks) + pick(string.ascii_letters + string.digits, r.randint(1, 4)), told()),
    ]
    harmless = [
        lambda: (passphrase(), words(2) + " "),
        lambda: (r.choice(["_", "=", "~", "+"]).join(made_up() for _ in range(r.randint(2, 4))), words(2) + " "),
        lambda: (made_up() + str(r.randint(0, 99)) + made_up(), words(2) + " "),
        lambda: (made_up() + made_up() + ":" + str(r.randint(0, 99)), words(2) + " "),
        lambda: (r.choice(DICTIONARY), words(1) + " " + r.choice(ASKS) + r.choice([" ", " ", ": "])),
        lambda: (made_up() + r.choice(["", "", ".", ",", ")"]), words(1) + " " + r.choice(ASKS) + " "),
        lambda: (r.choice(DICTIONARY) + r.choice("_-.") + r.choice(DICTIONARY) + str(r.randint(1, 9999)), words(3) + " "),
        lambda: ("/".join(made_up() for _ in range(r.randint(2, 5))) + r.choice([".html", ".py", ".json", "2024", "/v2"]), words(2) + " "),
        lambda: (pick(hexes, r.choice([8, 12, 32, 40, 64])), words(1) + " " + r.choice(DENIES) + r.choice([" ", ": ", "="])),
        lambda: ("-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), words(2) + " " + r.choice(["", "id ", "uuid="])),
        lambda: (pick(string.digits, r.randint(8, 20)), words(3) + " " + r.choice(["", "id=", "phone "])),
        lambda: (f"{pick(string.digits, 3)}-{pick(string.digits, 4)}-{pick(string.digits, 4)}", words(3) + " "),
        lambda: (".".join(str(r.randint(0, 255)) for _ in range(4)), words(3) + " "),
        lambda: (f"{made_up()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", words(3) + " "),
        lambda: (f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}", words(2) + " "),
        lambda: (f"https://{made_up()}.com/{made_up()}/{r.randint(1, 9999)}", words(2) + " "),
        lambda: (r.choice(["changeme", "example", "placeholder", "dummy", "test", "sample"]) + r.choice(["", "_", "-"]) + r.choice(DICTIONARY) + str(r.randint(1, 999)), words(1) + " " + asks()),
        lambda: (made_up() + made_up() + made_up() + str(r.randint(1, 99)), words(3) + " "),
        lambda: ("".join(made_up() for _ in range(8)), words(3) + " "),
        lambda: ("".join(made_up() for _ in range(7)).upper(), words(3) + " "),
        lambda: (r.choice("=-._~:/") * r.randint(20, 60), words(1) + " "),
        lambda: (f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}-beta{r.randint(1, 9)}", words(1) + " version "),
    ]
    rows = []
    for _ in range(min(n, FINDINGS)):
        for kind, label in ((r.choice(secret), 1), (r.choice(harmless), 0)):
            candidate, before = kind()
            rows.append((candidate, before, r.choice(["", "\" ", "' ", " "]) + words(2), label))
    return spark.createDataFrame(rows[:FINDINGS], "candidate string, before string, after string, secret int")


class Forest:
    """The trees of a fitted forest as nested tuples (feature, limit, left, right) with classes as leaves."""

    def __init__(self, text: str):
        self.trees = []
        lines = [line.strip() for line in text.splitlines()]
        starts = [i for i, line in enumerate(lines) if line.startswith("Tree ")]
        for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
            self.trees.append(self._tree(iter([x for x in lines[a + 1 : b] if x])))

    def _tree(self, lines: Iterator[str]):
        line = next(lines)
        if line.startswith("Predict"):
            return float(line.split()[1])
        feature, limit = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line).groups()
        left = self._tree(lines)
        next(lines)  # Else
        return int(feature), float(limit), left, self._tree(lines)

    def score(self, x: list[float]) -> float:
        """The share of trees that call it a secret."""
        votes = 0.0
        for tree in self.trees:
            while isinstance(tree, tuple):
                tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
            votes += tree
        return votes / len(self.trees)


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> Forest:
    """A forest from a bounded table of labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    rows = findings.limit(FINDINGS).collect()  # the bound of the training set
    spark = findings.sparkSession
    made = spark.createDataFrame([(float(r.secret), Vectors.dense(shape(r.candidate or " ", r.before or "", r.after or ""))) for r in rows], ["label", "features"])
    fitted = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(made.coalesce(2))
    return Forest(fitted.toDebugString)


def candidates(data: bytes) -> Iterator[tuple[int, int]]:
    """Spans in bytes of the candidates, in order; an asked value takes the place of the runs that it meets."""
    text = data.decode()
    asked, at, chars = [], 0, 0
    for m in ASKED.finditer(text):
        a = at + len(text[chars : m.start(1)].encode())
        at, chars = a + len(m[1].encode()), m.end(1)
        if (n := len(m[1].rstrip(".:,;"))) > 0:
            asked.append((a, a + len(m[1][:n].encode())))
    starts, stops = [a for a, _ in asked], [b for _, b in asked]
    free = [(a, b) for a, b in _runs(data) if bisect_right(starts, b - 1) == bisect_right(stops, a)]
    yield from sorted(asked + free)


def _runs(data: bytes) -> Iterator[tuple[int, int]]:
    """Spans of the character runs, in order."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], TOKEN[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    telling = ODD[raw]
    telling[1:] |= upper[1:] & lower[:-1]
    told = np.concatenate([[0], np.cumsum(telling)])
    size = edge[:, 1] - edge[:, 0]
    keep = (size >= LEAST) & ((told[edge[:, 1]] - told[edge[:, 0]] > 0) | (size >= LONG))
    for a, b in edge[keep].tolist():
        run = data[a:b].decode()
        if name := NAME.match(run):
            a += name.end()
        b -= len(data[a:b]) - len(data[a:b].rstrip(b".:,"))
        if b - a >= LEAST:
            yield a, b


def scan(data: bytes, forest: Forest) -> list[tuple[int, int, float]]:
    """(start, stop, score) in bytes of what the forest calls secrets."""
    found = []
    for a, b in candidates(data):
        before = data[max(0, a - 60) : a].decode("utf-8", "ignore")
        score = forest.score(shape(data[a:b].decode(), before, data[b : b + 20].decode("utf-8", "ignore")))
        if score >= THRESHOLD:
            found.append((a, b, score))
    return found


def redact(df: DataFrame, forest: Forest, text_col: str = "text", out: str = "findings") -> DataFrame:
    """`df` with secrets in `text_col` replaced by a mark, and `out`: (start, stop, score) in code points of the old text."""
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(forest)  # TREES trees of DEPTH levels
    index = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
        for part in slices(batches, text_col):
            texts, findings = [], []
            for text in part.column(index).to_pylist():
                data = (text or "").encode()
                found = scan(data, shared.value)
                at, chars, kept, spans = 0, 0, [], []
                for a, b, score in found:
                    gap = data[at:a].decode()
                    start = chars + len(gap)
                    kept += [gap, MARK]
                    stop = start + len(data[a:b].decode())
                    spans.append({"start": start, "stop": stop, "score": score})
                    at, chars = b, stop
                texts.append("".join([*kept, data[at:].decode()]) if found else text)
                findings.append(spans)
            columns = list(part.columns)
            columns[index] = pa.array(texts, pa.string())
            yield pa.record_batch([*columns, pa.array(findings, kind)], [*part.schema.names, out])
        give_back()

    extra = StructType.fromDDL(f"`{out}` array<struct<start:long,stop:long,score:double>>")
    return df.mapInArrow(run, StructType([*df.schema.fields, *extra.fields]))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the secrets of all documents, and their redacted texts' digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = redact(docs, train(labelled_findings(spark)))
    spans = F.concat_ws(";", F.transform("findings", lambda f: F.concat_ws("-", f["start"], f["stop"])))
    return done.select("doc_id", F.size("findings").cast("long").alias("n_secrets"), spans.alias("spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("redacted_sha256"))

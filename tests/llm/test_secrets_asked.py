"""What follows an asking word is a candidate whatever its characters; recall on whole texts."""

import random
import re
import string

from lumengrid.llm import secrets


def test_asked_values_are_candidates_whole():
    for value in ("HorseBattery", "qwertyASDFzxcv", "P@ss!w0rd#x", "Tr0ub4dor!2024", "pw", "pässwörd!é"):
        data = f"é the password: {value} and more".encode()
        assert value.encode() in [data[a:b] for a, b in secrets.candidates(data)]


def test_recall_through_scan(spark):
    forest = secrets.train(secrets.labelled_findings(spark))
    r = random.Random(8)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hit, n, false = 0, 0, 0
    for i in range(300):
        kind = i % 3
        value = pick(string.ascii_letters, 14) if kind == 0 else pick(string.ascii_letters + string.digits, 5) + "!" + pick(string.ascii_letters + string.digits + "#$%&*", 8) if kind == 1 else r.choice(["Horse", "Tiger", "Monkey"]) + r.choice(["Battery", "Castle", "Garden"])
        data = f"Please note the {r.choice(['password', 'api_key', 'token'])}{r.choice([': ', '=', ' = '])}{value} for the next week".encode()
        n += 1
        hit += value.encode() in [data[a:b] for a, b, _ in secrets.scan(data, forest)]
        plain = f"Please keep the {r.choice(['password', 'key', 'token'])} {r.choice(['was', 'for', 'with', 'which', 'and'])} in the house".encode()
        false += bool(secrets.scan(plain, forest))
    print("recall", hit / n, "false", false / n)
    assert hit / n > 0.9 and false / n < 0.05


def plain_candidates(text):
    """Spans in characters, by plain rules: asked values, and runs that are no plain words and meet none of them."""
    asked = [(m.start(1), m.start(1) + len(m[1].rstrip(".:,;"))) for m in secrets.ASKED.finditer(text) if m[1].rstrip(".:,;")]
    found = list(asked)
    for m in re.finditer(r"[A-Za-z0-9_+/=.~:@-]+", text):
        run = m[0]
        if len(run) < secrets.LEAST or not (len(run) >= secrets.LONG or re.search(r"[0-9_+=~]|[a-z][A-Z]", run)):
            continue
        a = m.start() + (secrets.NAME.match(run).end() if secrets.NAME.match(run) else 0)
        b = a + len(text[a : m.end()].rstrip(".:,"))
        if b - a >= secrets.LEAST and not any(a < y and x < b for x, y in asked):
            found.append((a, b))
    return sorted(found)


def test_candidates_and_scores_equal_plain_rules(spark, documents, texts):
    """Every candidate by plain rules is scored once, by the plain mean of the trees, and redacted if it reaches the threshold."""
    forest = secrets.train(secrets.labelled_findings(spark))

    def plain_score(x):
        votes = []
        for tree in forest.trees:
            while not isinstance(tree, float):
                feature, limit, left, right = tree
                tree = left if x[feature] <= limit else right
            votes.append(tree)
        return sum(votes) / len(votes)

    own = [*texts, *[r.text for r in documents.collect() if r.text and len(r.text) < 20_000]]
    seen = 0
    for text in own:
        data = text.encode()
        spans = [(len(data[:a].decode()), len(data[:b].decode())) for a, b in secrets.candidates(data)]
        assert spans == plain_candidates(text)
        want = []
        for a, b in spans:
            before, after = data[: len(text[:a].encode())][-60:].decode("utf-8", "ignore"), data[len(text[:b].encode()) :][:20].decode("utf-8", "ignore")
            if plain_score(secrets.shape(text[a:b], before, after)) >= secrets.THRESHOLD:
                want.append((a, b))
        got = [(len(data[:a].decode()), len(data[:b].decode())) for a, b, _ in secrets.scan(data, forest)]
        assert got == want
        seen += len(spans)
    assert seen > 100


def test_recall_and_precision_on_documents(spark, documents):
    """Secrets of every kind, planted at the ends of sentences of documents, are found; what is no secret is left."""
    forest = secrets.train(secrets.labelled_findings(spark))
    texts = [r.text for r in documents.orderBy("doc_id").collect() if r.text and 200 < len(r.text) < 5000][:120]
    planted = secrets.labelled_findings(spark, 600, seed=77).collect()
    r = random.Random(5)
    hit, n, wrong, plain = 0, 0, 0, 0
    for i, row in enumerate(planted):
        text = texts[i % len(texts)]
        at = text.find(" ", r.randint(0, len(text) // 2)) + 1
        own = f"{text[:at]}{row.before}{row.candidate} {text[at:]}"
        found = [own.encode()[a:b].decode() for a, b, _ in secrets.scan(own.encode(), forest)]
        core = row.candidate.rstrip(".:,;")
        if row.secret:
            n += 1
            hit += core in found
        else:
            plain += 1
            wrong += core in found
    print("recall", hit / n, "wrong", wrong / plain)
    assert hit / n > 0.9 and wrong / plain < 0.1

import base64
import random
import re
import string

import pyarrow as pa
import pytest

from vexel.llm import secret_scan as sc
from vexel.llm.common import table

SF = "/root/testdata/sf0.01"
HEX = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"


def bpe(word: bytes) -> int:
    """Byte-pair encoding as it is defined: merge the pair of the least rank until there is none."""
    with open(sc.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    n = 0
    for part in re.findall(rb"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", word):
        p = [part[i : i + 1] for i in range(len(part))]
        while len(p) > 1:
            best = min((ranks.get(p[i] + p[i + 1], 1 << 30), i) for i in range(len(p) - 1))
            if best[0] == 1 << 30:
                break
            p[best[1] : best[1] + 2] = [p[best[1]] + p[best[1] + 1]]
        n += len(p)
    return n


NAME = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)s?"


def expected(text):
    """(start, string) of each finding of a text: every rule as the docstrings have it, on characters, one string after another."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_\-!$%^&*.=~@#]{16,}", text):
        run, lead = m.group(), text[: m.start()]
        quoted = lead.endswith(("'", '"'))
        skip = 0 if quoted else len(run) - len(run.lstrip("="))
        told = re.fullmatch(rf"(?is)(?:.*[^a-z])?{NAME}=+(.+?)(?:&[a-z_]+=.*)?", run)
        values = []
        if told:
            values = [(told.start(1), told.group(1), True)]
        elif re.search(rf"(?i){NAME}[\"']?\s{{0,3}}(?:[:=]|=>|\s)\s{{0,3}}[\"']?$", lead[-48:] + run[:skip]):
            values = [(skip, run[skip:], True)]
        values = [(at, w if quoted else w.rstrip(".!"), True) for at, w, _ in values]
        values += [(x.start(), x.group(), False) for x in re.finditer(r"[A-Za-z0-9+/_-]{16,}", run)]
        core = re.search(r"[A-Za-z0-9](?:.*[A-Za-z0-9])?", run)
        if core and not re.fullmatch(r"[A-Za-z0-9+/_-]+", core.group()):
            values.append((core.start(), core.group(), False))
        taken = set()
        for at, w, named in values:
            if len(w) < 16 or taken & set(range(at, at + len(w))):
                continue
            if re.fullmatch(r"(?i)[0-9a-f]+", w) and len(w) in (32, 40, 56, 64, 96, 128):
                if not named:
                    continue
            elif re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9+/_.-]+", w):
                continue
            elif not named and re.fullmatch(r"[^@]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|/{0,2}([A-Za-z0-9-]+\.)+[A-Za-z]{2,}(/.*)?", w):
                continue
            shaped = re.fullmatch(r"[a-z+/_-]+|[A-Z+/_-]+|[A-Z]?[a-z]+([A-Z][a-z]+)*|([A-Za-z]+[0-9]{0,4}[/_-])+[A-Za-z]*[0-9]{0,4}", w) or re.search(r"[!$%^&*.=~@#]", w)
            n = bpe(w.encode())
            if len(w) / n < (1.9 if shaped and not named else 2.5):
                out.append((m.start() + at, len(w), n, named))
                taken |= set(range(at, at + len(w)))
    return out


def test_against_brute_force(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    want = {(r.doc_id, *x) for r in rows for x in expected(r.text)}
    got = {(r.doc_id, r.start, r.n_chars, r.n_tokens, r.named) for r in sc.op3_token_efficiency(spark, SF).collect()}
    assert got == want and len(got) > 5


CLASSES = {"lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "mixed": string.ascii_letters, "alphanumeric": string.ascii_letters + string.digits, "punctuation": string.ascii_letters + string.digits + "!$%^&*.=~"}


@pytest.mark.parametrize("kind", CLASSES)
def test_random_strings_of_all_classes(kind):
    rng = random.Random(5)
    words = ["".join(rng.choices(CLASSES[kind], k=24)) for _ in range(300)]
    for text in ('password = "{}" and', "password={}", "api_key: '{}'", "?x=1&token={}&page=2"):
        found = sc.scan_texts(pa.array([text.format(w) for w in words]))
        assert len({x[0] for x in found if x[5]}) >= (0.95 if "page" not in text else 0.9) * len(words), (kind, text, len(found))
    whole = sc.scan_texts(pa.array([f'password = "{w}"' for w in words]))
    assert all((x[1], x[2]) == (12, 24) for x in whole)
    bare = len({x[0] for x in sc.scan_texts(pa.array([f"see {w} here" for w in words]))})
    assert bare >= (0.9 if kind != "punctuation" else 0.75) * len(words), (kind, bare)


def test_ordinary_words_are_left_alone():
    for t in ("internationalization counterrevolutionaries", "see https://www.example.org/some/path?page=2&ref=x and mail.server@example.com.", "def function_name(first_argument=None): return first_argument.lower()", "192.168.100.200.1.2.3.4", "the end...................."):
        assert sc.scan_texts(pa.array([t])) == [], t


def test_what_is_known_is_left_out():
    def found(t):
        return [(x[1], x[2], x[5]) for x in sc.scan_texts(pa.array([t]))]

    assert found(f"commit {HEX} is fine") == []
    assert found(f'é token = "{HEX}"') == [(11, 40, True)]
    assert found("id 123e4567-e89b-12d3-a456-426614174000 and 2024-01-01-12345678") == []
    assert found("internationalization_of_everything usr/local/lib/python3/site AnInternationalClassName") == []
    assert found("see xK9vQ2mP8zR4tW7yB3nL6cF1 here") == [(4, 24, False)]
    assert found("secret: unbelievablylongword") == []


def test_nulls_empty_long_and_repeats(spark):
    t = f'password = "{HEX}"'
    d = spark.createDataFrame([(1, None), (2, ""), (None, t), (3, t), (3, t), (4, "word " * 300_000 + t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.start) for r in sc.scan(d.selectExpr("doc_id", "text", "1 AS start", "2 AS named")).collect())
    assert got == [(0, 12), (3, 12), (3, 12), (4, 1_500_012)]
    assert sc.scan(d.limit(0)).count() == 0


def test_letters_only_are_judged_by_the_ratio():
    import random
    import string

    rng = random.Random(0)
    shapes = [lambda: "".join(rng.choices(string.ascii_lowercase, k=32)), lambda: "".join(rng.choices(string.ascii_uppercase, k=32)), lambda: "sk_live_" + "".join(rng.choices(string.ascii_letters, k=24)), lambda: "".join(rng.choices(string.ascii_lowercase, k=16))]
    for f, bare in zip(shapes, (0.95, 0.95, 0.95, 0.8)):
        words = [f() for _ in range(300)]
        assert len(sc.scan_texts(pa.array([f'token = "{w}"' for w in words]))) >= 0.99 * len(words)
        assert len(sc.scan_texts(pa.array([f"see {w} here" for w in words]))) >= bare * len(words)

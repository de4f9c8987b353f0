import base64
import random
import re
import string

import pytest

from packetlens.llm import secret_scan as ss


def base_brute(text):
    """The contract's search, match by match."""
    found = []
    key = re.compile(
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    )
    for kind, pattern, least in (("assign", key, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 20), ("hex", re.compile(r"[0-9a-f]+"), 24)):
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), ss.KINDS.index(kind), m.end()))
    return sorted(found)


def cases():
    rng = random.Random(8)
    alphabet = "abcdef0123456789 AKI=:\"'_-.ſ" + "ßé漢"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(150)]
    words = ["password", "PassWd", "secret", "token", "API_KEY", "apikey", "AKIA", "key"]
    for _ in range(300):
        parts = [rng.choice([rng.choice(words), rng.choice([" = ", ":", '": "', "=", " "]), "x1y2z3", "ABC123" * 4, "0a" * 13]) for _ in range(8)]
        made.append("".join(parts))
    return [*made, "secret: token: abcdefgh", "paſſword=abcdefgh", "AKIA" * 6, "a" * 24, "a" * 23, None, ""]


def test_base_equals_brute_force(docs):
    rows = list(enumerate(cases()))
    got = {r.doc_id: r.spans for r in ss.find_secrets(docs(*rows)).collect()}
    for i, text in rows:
        mine = [(s.start, ss.KINDS.index(s.kind), s.stop) for s in got[i] if s.kind != "random"]
        assert mine == base_brute(text)
        whole = [(s.start, ss.KINDS.index(s.kind)) for s in got[i]]
        assert whole == sorted(whole)


def test_random_strings_are_found_and_known_ones_are_not(docs):
    rng = random.Random(3)
    hidden = [base64.b64encode(rng.randbytes(24)).decode() for _ in range(40)]
    known = [
        "550e8400-e29b-41d4-a716-446655440000",
        "D41D8CD98F00B204E9800998ECF8427E",
        "thisIsAnOrdinaryIdentifier2",
        "some_snake_case_name_number_12",
        "Donaudampfschifffahrtsgesellschaft",
        "12345678901234567890123456",
        "path/to/some/folder/file2023",
        "-" * 60,
        "=" * 40 + "1a",
    ]
    rows = [*enumerate(f"see é {x} there" for x in hidden), *((100 + i, f"see {x} there") for i, x in enumerate(known))]
    got = {r.doc_id: r.spans for r in ss.find_secrets(docs(*rows)).collect()}
    found = [dict(rows)[i][s.start : s.stop] for i in range(40) for s in got[i]]
    assert sum(f in hidden for f in found) >= 38
    assert all(s.kind != "random" for i in range(len(known)) for s in got[100 + i])


def test_edges(docs):
    assert ss.find_secrets(docs()).collect() == []
    long = "word " * 100_000 + "token=abcdef1234"
    table = docs((None, long), (1, long), (1, long), extra=", spans int, id string", values=(1, "x"))
    got = ss.find_secrets(table).collect()
    assert [len(r.spans) for r in got] == [1, 1, 1] and got[0].spans[0].start == 500_000


ALPHABETS = {
    "lower": string.ascii_lowercase + string.digits,
    "upper": string.ascii_uppercase + string.digits,
    "base32": string.ascii_uppercase + "234567",
    "base32_lower": string.ascii_lowercase + "234567",
    "base62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
    "letters": string.ascii_letters,
}


def recall(docs, made, before="", after=""):
    """Share of strings that a random span covers to nine tenths at least."""
    rows = list(enumerate(f"see {before}{x}{after} there" for x in made))
    got = {r.doc_id: r.spans for r in ss.find_secrets(docs(*rows)).collect()}
    start = len("see " + before)
    found = 0
    for i, x in enumerate(made):
        part = [min(s.stop, start + len(x)) - max(s.start, start) for s in got[i] if s.kind == "random"]
        found += 10 * max(part, default=0) >= 9 * len(x)
    return found / len(made)


@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("length", [16, 20, 32, 40])
def test_recall_by_alphabet_and_length(docs, alphabet, length):
    rng = random.Random(length)
    made = ["".join(rng.choice(ALPHABETS[alphabet]) for _ in range(length)) for _ in range(300)]
    assert recall(docs, made) >= (0.75 if length == 16 else 0.8 if length == 20 else 0.9)


@pytest.mark.parametrize(
    "before, after",
    [
        ("authorization_bearer=", ""),
        ("session_identifier=", ""),
        ("connection_string=", ""),
        ("https://example.com/path/to/some/resource/", ""),
        ("/some/folder/", "/and/another/long/folder/name"),
        ("0a1b2c3d4e5f" * 2 + "/", ""),
        ("AKIA" + "Q7" * 8 + "/", ""),
    ],
)
def test_recall_inside_a_run(docs, before, after):
    rng = random.Random(len(before))
    made = ["".join(rng.choice(ALPHABETS["base62"]) for _ in range(32)) for _ in range(300)]
    assert recall(docs, made, before, after) >= 0.98

import hashlib
import itertools
import random
import re

import pytest

from packetlens.llm import repair

COLUMNS = "conv_id bigint, turn bigint, role string, text string"
SPACE = "\t\n\x0b\x0c\r "


def brute(rows):
    """Every edit of every row with up to two insertions at each place: least (cost, audit)."""
    best = None
    inserts = [w for n in range(3) for w in itertools.product("ua", repeat=n)]
    edits = [("K", None), ("R", "u"), ("R", "a"), ("D", None)]
    for chosen in itertools.product(edits, repeat=len(rows)):
        cost, good = 0, True
        for (initial, must_go, truncated, _), (letter, _) in zip(rows, chosen):
            cost += {"K": 0, "R": 2, "D": 3}[letter] + (truncated and letter != "D")
            good &= not must_go or letter == "D"
        if not good or best is not None and cost > best[0]:
            continue
        for extra in itertools.product(inserts, repeat=len(rows) + 1):
            whole = cost + 2 * sum(map(len, extra))
            roles = audit = ""
            for place, words in enumerate(extra):
                roles, audit = roles + "".join(words), audit + "I" * len(words)
                if place < len(rows):
                    letter, role = chosen[place]
                    audit += letter
                    roles += "" if letter == "D" else role or rows[place][0]
            if re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (whole, audit), (whole, audit))
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_agenda_finds_the_least_of_all_derivations(n):
    random.seed(n)
    kinds = [(i, g, t and not g, 1) for i in "suax" for g in (False, True) for t in (False, True)]
    cases = list(itertools.product(kinds, repeat=n))
    for rows in random.sample(cases, min(len(cases), 25 if n == 3 else 120)):
        assert list(repair.derive(rows).values()) == [brute(rows)]


def test_copies_are_single_rows_in_turn():
    plain = (("u", False, True, 1), ("u", True, False, 1), ("u", True, False, 1), ("a", False, False, 1))
    short = (("u", False, True, 3), ("a", False, False, 1))
    assert repair.derive(plain) == repair.derive(short)


def test_runs_compose_to_the_whole():
    random.seed(4)
    kinds = [(i, g, t, c) for i in "suax" for g in (False, True) for t in (False, True) for c in (1, 1, 2)]
    for _ in range(150):
        rows = tuple(random.choices(kinds, k=random.randrange(2, 14)))
        cuts = sorted(random.sample(range(1, len(rows)), random.randrange(1, min(4, len(rows)))))
        tables = [
            [(a, b, c, x) for a in range(4) for b, (c, x) in repair.derive(part, a, False).items()]
            for part in (rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)]))
        ]
        ranked = [sorted({w[3] for w in t}) for t in tables]
        total, letters, path = repair.choose(
            [[(a, b, c, r.index(x)) for a, b, c, x in t] for t, r in zip(tables, ranked)]
        )
        audit = "".join(next(x for a, b, _, x in t if (a, b) == p) for t, p in zip(tables, path)) + letters
        assert [(total, audit)] == list(repair.derive(rows).values())


def expected(rows):
    """The report and the repaired lines of one conversation's rows, row by row."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, kinds, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = None
        if not bare:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif bare[-1] not in ".!?":
            fault = "truncated"
        if fault:
            faults[fault] += 1
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        kinds.append((initial, fault in ("blank", "duplicate"), fault == "truncated", 1))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds[:-1], kinds[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    ((state, (cost, audit)),) = repair.derive(tuple(kinds)).items()
    lines, left, last = [], iter(rows), ""
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(left)[1:]
        if letter != "D":
            role = role if letter == "K" else ("assistant" if last == "u" else "user")
            last = role[0]
            lines.append((letter, role, text))
    return [gaps, *faults.values(), illegal, cost, audit], lines


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(row)
    return out


def made(count, most, seed):
    random.seed(seed)
    texts = ["Hello.", "yes", "What?", "", "  \n", "Long text with words!", "né…", "ok.\t"]
    rows = []
    for conv in range(count):
        for turn in range(random.randrange(1, most)):
            at = None if random.random() < 0.05 else turn * random.choice([1, 1, 2])
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, at, role, random.choice(texts + [None, f"Text {turn}.", f"text {turn}"])))
            if random.random() < 0.2:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("run_rows,count,most", [(512, 40, 9), (3, 25, 60)])
def test_report_rows_and_digest(spark, monkeypatch, run_rows, count, most):
    monkeypatch.setattr(repair, "RUN_ROWS", run_rows)
    rows = made(count, most, run_rows) + [(None, 1, "user", "Of nobody."), (None, None, "assistant", "Yes.")]
    table = spark.createDataFrame(rows, COLUMNS)
    facts = repair.report(table)
    lines = {}
    for r in repair.repaired(table, facts).collect():
        lines.setdefault(r.conv_id, []).append((r.place, r.edit, r.role, r.text))
    got = {r.conv_id: r for r in repair.with_digest(table, facts).collect()}
    wanted = by_conversation(rows)
    assert set(got) == set(wanted)
    for conv, mine in wanted.items():
        report, text = expected(mine)
        assert [got[conv][f] for f in repair.FACTS] == report
        assert [x[1:] for x in sorted(lines.get(conv, []))] == text
        joined = "\n".join(f"{role}:{x}" for _, role, x in text)
        assert got[conv].repaired_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_empty_tables_ids_without_rows_and_clashing_names(spark):
    ids = spark.createDataFrame([("a", "x"), ("b", "y")], "conv_id string, audit string")
    names = "conv_id string, turn int, role string, text string, conv string, cost int, digest int, copies int, head int"
    rows = spark.createDataFrame([("a", 0, "user", "Hi.", "z", 1, 2, 3, 4)], names)
    got = {r.conv_id: r for r in repair.with_digest(rows, repair.report(rows, ids=ids)).collect()}
    assert got["a"].audit == "KI" and got["a"].cost == 2
    assert list(got["b"][1:]) == [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]
    none = rows.limit(0)
    assert repair.report(none).collect() == []
    assert repair.with_digest(none, repair.report(none)).collect() == []


def test_one_row_many_times_and_a_very_long_text(spark):
    table = spark.range(3000).selectExpr("1L as conv_id", "5L as turn", "'user' as role", "'Same.' as text")
    long = spark.createDataFrame([(1, 6, "assistant", "word " * 200_000)], COLUMNS)
    (got,) = repair.report(table.unionByName(long)).collect()
    assert got.audit == "K" + "D" * 2999 + "K"
    assert (got.duplicate, got.truncated, got.illegal, got.cost) == (2999, 1, 2999, 3 * 2999 + 1)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    import zlib

    wanted = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind, role, text = zlib.crc32(key.encode()) % 20, role or " ", text or " "
        if kind:
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            wanted += [(c, t, role, text)] * (2 if kind == 3 else 1)
    got = repair.damaged(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))

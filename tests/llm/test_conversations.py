"""Conversation repair against trying all edits and against a plain walk over the grammar's states."""

import random
import re
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

from tagloom.llm import conversations
from tagloom.llm.conversations import Parse, Tables, repaired_turns

KINDS = "conv_id long, turn long, role string, text string, row int, part string, at int, first string, sha string"


def all_edits(rows):
    """The least (cost, audit, turns) over all sequences of edits with few insertions."""
    found = []

    def go(k, cost, audit, turns, inserted):
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in turns)) and k == len(rows):
            found.append((cost, audit, turns))
        if inserted < len(rows) + 2 and audit.count("I") < 5:
            for name in ("user", "assistant"):
                if not turns or turns[-1][0][:1] != name[:1]:
                    go(k, cost + 2, audit + "I", [*turns, (name, "")], inserted + 1)
        if k < len(rows):
            role, text, must_go, more = rows[k]
            go(k + 1, cost + 3, audit + "D", turns, inserted)
            if not must_go:
                go(k + 1, cost + more, audit + "K", [*turns, (role, text)], inserted)
                for name in ("user", "assistant"):
                    go(k + 1, cost + 2 + more, audit + "R", [*turns, (name, text)], inserted)

    go(0, 0, "", [], 0)
    return min(found)


def walked(rows):
    """(cost, audit, turns) by states: 0 nothing, s, u, a."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    live = {"0": (0, "", ())}

    def closed(live):
        for x, name in ("u", "user"), ("a", "assistant"):
            for state in list(live):
                if (state, x) in step:
                    cost, audit, turns = live[state]
                    new = (cost + 2, audit + "I", (*turns, (name, "")))
                    live[x] = min(live.get(x, new), new, key=lambda e: e[:2])
        return live

    live = closed(live)
    for role, text, must_go, more in rows:
        onward = {}
        for state, (cost, audit, turns) in live.items():
            options = [(state, (cost + 3, audit + "D", turns))]
            if not must_go:
                options += [(step.get((state, role[:1])), (cost + more, audit + "K", (*turns, (role, text))))]
                options += [(step.get((state, n[0])), (cost + 2 + more, audit + "R", (*turns, (n, text)))) for n in ("user", "assistant")]
            for nxt, entry in options:
                if nxt:
                    onward[nxt] = min(onward.get(nxt, entry), entry, key=lambda e: e[:2])
        live = closed(onward)
    return min((live[x] for x in "0a" if x in live), key=lambda e: e[:2])


def plain(rows):
    """What the query returns, from (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        groups[conv]
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code, role, text = crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            groups[conv] += [(turn, "user" if code == 4 else role, text)] * (1 + (code == 3))
    out = []
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha256(r[2].encode()).hexdigest()))
        seen, ready, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in group:
            last = text.strip(" \t\n\v\f\r")[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            ready.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in group if t is not None}
        letters = [r[:1] for r, *_ in ready]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        cost, audit, made = walked(ready)
        digest = sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=str)


def some_rows(rng, conv, n):
    roles = ["system", "user", "assistant", "tool", "", None, "ua", "\U0001f600"]
    weights = [2, 8, 8, 1, 0.3, 0.3, 0.5, 0.2]
    texts = ["Yes.", "No", " \t", None, "What?", "a\nb! ", "é…", "x" * 50]
    return [
        (conv, rng.choice([k, k, k, k + 1, None]), rng.choices(roles, weights)[0], rng.choice(texts) if rng.random() < 0.4 else f"Text {k}.", 1, "p", 2, "f", "s")
        for k in range(n)
    ]


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(12)
    rows = [r for conv in range(120) for r in some_rows(rng, conv, rng.randint(1, 14))]
    rows += some_rows(rng, None, 9) + [(500, k, "user", "again.", 1, "p", 2, "f", "s") for k in range(300)]
    rows += [(501 + k, 3, "user", "One.", 1, "p", 2, "f", "s") for k in range(60)]  # some lose their only row
    rows += some_rows(rng, 700, 1_500) + [(701, 0, "user", "long " * 200_000 + ".", 1, "p", 2, "f", "s")]
    rows += rows[:40]  # repeated rows
    rng.shuffle(rows)
    return rows


def test_small_conversations_by_all_edits():
    rng, tables = random.Random(3), Tables()
    for _ in range(250):
        rows = [(rng.choice(["system", "user", "assistant", "x"]), f"t{k}", rng.random() < 0.15, int(rng.random() < 0.3)) for k in range(rng.randint(0, 4))]
        parse = Parse(tables)
        for role, text, must_go, more in rows:
            parse.row(role, text, must_go, bool(more))
        cost, audit, digest = parse.best()
        want = all_edits(rows)
        assert (cost, audit.decode()) == want[:2] == walked(rows)[:2]
        assert digest.digest.hexdigest() == sha256("\n".join(f"{r}:{t}" for r, t in want[2]).encode()).hexdigest()
        assert list(repaired_turns(tables, (0,), audit, iter([r[:2] for r in rows]))) == want[2]


def test_equal_tops_take_the_same_continuations():
    tables = Tables()
    reached, at = {(0,)}, [(0,)]
    for stack in at:
        for x in tables.alphabet:
            nxt = tables.shift(stack, x)
            if nxt is not None and nxt not in reached:
                reached.add(nxt)
                at.append(nxt)
    classes = {s: (s[-1], tables.accepts(s), *[(n := tables.shift(s, x)) and n[-1] for x in tables.alphabet]) for s in reached}
    assert len(set(classes.values())) == len({s[-1] for s in reached}) < len(reached)


def test_equals_plain_implementation(spark, talk):
    frame = spark.createDataFrame(talk, KINDS).repartition(5)
    got = sorted((tuple(r) for r in conversations.repair(conversations.damage(frame)).collect()), key=str)
    assert got == plain(talk)
    assert any(r[7] == "" and r[8] == sha256().hexdigest() for r in got)


def test_conversations_over_many_ranges(spark, talk, monkeypatch):
    """Segments of few rows, all conversations through the path for long ones."""
    monkeypatch.setattr(conversations, "RUN", 50)
    monkeypatch.setattr(conversations, "CHUNK", 2_000)
    frame = spark.createDataFrame(talk, KINDS)
    got = conversations._spread(conversations._ready(conversations.damage(frame))).select("conv_id", *conversations.RESULT, "audit", "repaired_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == [r for r in plain(talk) if r[7]]


def test_empty_table(spark):
    assert conversations.repair(conversations.damage(spark.createDataFrame([], KINDS))).collect() == []

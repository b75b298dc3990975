"""Structure repair against a search through all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from threadloom.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired turns) by trying every edit at every place."""
    seen, faults = set(), []
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append("")
        seen.add((role, text))

    @functools.cache
    def best(i, said):
        """said: the last two initials, and whether nothing was said."""
        found = []
        if i == len(rows) and (said == "" or said == "a"):
            found.append((0, "", ()))
        for role in ("user", "assistant"):
            if legal(said, role[0]) and len(path) < 3:
                path.append(1)
                c, a, t = best.__wrapped__(i, role[0])
                path.pop()
                found.append((c + 2, "I" + a, ((role, ""), *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = fresh(i + 1, said)
            found.append((c + 3, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                for to, cost, edit in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                    if legal(said, to[:1]):
                        c, a, t = fresh(i + 1, to[:1])
                        found.append((c + cost + more, edit + a, ((to, text), *t)))
        return min(found, default=(10**9, "", ()))

    path = []

    def fresh(i, said):
        held, path[:] = list(path), []
        out = best(i, said)
        path[:] = held
        return out

    def legal(said, initial):
        return initial in {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}.get(said, ())

    return (*best(0, ""), faults)


def damage(row):
    conv, turn, role, text = row
    said = lambda v: " " if v is None else str(v)
    k = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
    role, text = said(role), said(text)
    text = "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text
    out = (conv, turn, "user" if k == 4 else role, text)
    return [] if k == 0 else [out] * 2 if k == 3 else [out]


def expected(table):
    groups = {}
    for row in table:
        groups.setdefault(row[0], []).extend(r[1:] for r in damage(row))
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        cost, audit, turns, faults = cheapest(rows)
        numbers = {t for t, _, _ in rows if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in turns)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def random_table(seed, conversations=60, longest=12):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "agent"]
    texts = ["Yes.", "No", "What?", "", " \t\n", None, "Done!  ", "a" * 500 + ".", " ", "ok ", "1.2", "Yes."]
    out = []
    for conv in [*range(conversations), None]:
        for turn in range(draw.randint(1, longest)):
            role = draw.choice(roles) if draw.random() < 0.4 else ("user", "assistant")[turn % 2]
            number = draw.choice([turn, turn, turn, turn * 3, None, 5, -2])
            text = draw.choice(texts) if draw.random() < 0.5 else f"Sentence {turn}."
            out.append((conv, number, role, text))
    return out


def found(df):
    return {r.conv_id: tuple(r[c] for c in (*repair.COUNTS, "audit", "repaired_sha256")) for r in df.collect()}


def written(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/conversations.parquet")
    return f"file://{tmp_path}"


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("long, bits", [(repair.LONG, repair.PIECE_BITS), (4, 2), (0, 0)])
def test_repair_equals_a_search_through_all_edits(spark, tmp_path, seed, long, bits):
    table = random_table(seed)
    out = found(repair.op11(spark, written(spark, tmp_path, table), long, bits))
    assert out == expected(table)


def test_one_conversation_with_most_rows_is_spread(spark, tmp_path):
    draw = random.Random(5)
    table = [(7, t, draw.choice(["user", "assistant", "assistant", "system"]), f"{draw.randint(0, 900)}" + draw.choice([".", ""])) for t in range(3000)]
    table += random_table(6, 20)[:100]
    at = written(spark, tmp_path, table)
    whole = found(repair.op11(spark, at))
    assert found(repair.op11(spark, at, long=500, piece_bits=6)) == whole
    pieces = repair.repaired(repair.damaged(spark.read.parquet(f"{at}/conversations.parquet")), long=500, piece_bits=6)
    of_7 = pieces.where("conv_id = 7").orderBy("piece").collect()
    assert len(of_7) > 30 and max(len(p.turns) for p in of_7) <= 3 * 64
    roles = "".join(t.role[0] for p in of_7 for t in p.turns)
    assert re.fullmatch("(s?(ua)+)?", roles)
    assert sum(p.cost for p in of_7) == whole[7][5] and "".join(p.audit for p in of_7) == whole[7][6]


def test_other_columns_empty_tables_and_conversations_that_lose_all_turns(spark, tmp_path):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Hi.", "x", 1), (None, None, None, None, "y", 2)]
    at = written(spark, tmp_path, rows, SCHEMA + ", audit string, cost int")
    out = found(repair.op11(spark, at))
    assert out[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and len(out) == 2
    none = written(spark, tmp_path / "none", [])
    assert found(repair.op11(spark, none)) == {}


def test_registered_query_on_a_table(spark, sf_dir):
    out = found(queries.queries()["op11_structure_repair"](spark, sf_dir))
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert out == expected(table)
    assert sum(v[5] > 0 for v in out.values()) > 5


def test_turns_after_follow_the_audit():
    assert repair.turns_after(b"DIKR", ["tool", "assistant", "tool"], ["x", "y", "z"]) == [("user", ""), ("assistant", "y"), ("user", "z")]


def test_query_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    name = "op11_structure_repair"
    rows = con.execute(f"SELECT conv_id, {', '.join(repair.COUNTS)}, audit, repaired_sha256 FROM ({queries.oracle_sql()[name]})").fetchall()
    assert {r[0]: tuple(r[1:]) for r in rows} == found(queries.queries()[name](spark, sf_dir))

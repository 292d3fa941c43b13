"""Quotes of many lines: against brute force, and ten thousand lines in a heap of one gigabyte."""

import random
import subprocess
import sys

import pytest

from rollcall.llm import quotes

ROOT = __file__.rsplit("/tests/", 1)[0]


@pytest.mark.parametrize("block", [1024, 3])
def test_runs_of_lines_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(quotes, "BLOCK", block)
    rnd = random.Random(block)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(6):
            own = [rnd.choice(["a", "b", "a  b", "C", "", "thanks", "é"]) for _ in range(rnd.choice([0, 3, 17, 60]))]
            text = []
            for _ in range(rnd.randint(0, 3)):
                if said and rnd.random() < 0.8:
                    source = rnd.choice(said)
                    if source:
                        i = rnd.randrange(len(source))
                        text += [f"> {x}" for x in source[i : i + rnd.choice([1, 2, 3, 8, 9, 33])]] + ["reply"]
                else:
                    text += [">> other", "> a", "> c", "so"]
            rows.append((conv, turn, "user", "\n".join([*own[: len(own) // 2], *text, *own[len(own) // 2 :]])))
            said.append(own)
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn, r.level, r.line): r.source_turn for r in quotes.link_quotes(chats).collect()}

    def parsed(text):
        out = []
        for line in text.split("\n"):
            level = 0
            while line.lstrip(" \t").startswith(">") and len(line) - len(line.lstrip(" \t")) <= 3:
                level, line = level + 1, line.lstrip(" \t")[1:]
            out.append((level, " ".join(line.lower().split())))
        return out

    want = {}
    for conv in range(12):
        held = []
        for _, turn, _, text in [r for r in rows if r[0] == conv]:
            lines = [(i, level, body) for i, (level, body) in enumerate(parsed(text)) if body]
            runs = []
            for i, level, body in lines:
                if runs and runs[-1][1] == level and runs[-1][3][-1][0] == lines[[x[0] for x in lines].index(i) - 1][0]:
                    runs[-1][3].append((i, body))
                else:
                    runs.append([i, level, None, [(i, body)]])
            for i, level, _, own in runs:
                if level:
                    bodies = [b for _, b in own]
                    n, whole = len(bodies), " ".join(bodies)
                    hit = [t for t, mine, parts in held if whole in mine or whole in parts or any(mine[j : j + n] == bodies for j in range(len(mine) - n + 1))]
                    want[conv, turn, level, i] = max(hit, default=None)
            mine = [b for _, level, b in lines if level == 0]
            parts, part = [], []
            for level, body in [*parsed(text), (1, "end")]:
                if level == 0 or not body:
                    part += [body] if level == 0 and body else []
                else:
                    parts, part = [*parts, " ".join(part)], []
            held.append((turn, mine, [p for p in parts if p]))
    assert got == want and sum(v is not None for v in want.values()) > 40


def test_ten_thousand_lines_in_a_small_heap(tmp_path):
    """A message of 20,000 lines, half of which the next one quotes; every line alike in the third conversation."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "1g").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from rollcall.llm.quotes import link_quotes
rows = []
for conv, line in enumerate((lambda i: f"line number {{i}} of the long message", lambda i: f"x{{i % 7}}", lambda i: "same")):
    lines = [line(i) for i in range(20_000)]
    rows += [(conv, 0, "user", "\\n".join(lines)), (conv, 1, "user", "\\n".join("> " + x for x in lines[5000:15000]) + "\\nyes"), (conv, 2, "user", "> " + "\\n> ".join(lines[100:4000]) + "\\nno")]
chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
got = sorted((r.conv_id, r.turn, r.source_turn) for r in link_quotes(chats).select("conv_id", "turn", "source_turn").collect())
assert got == [(c, t, 0) for c in range(3) for t in (1, 2)], got
print("linked")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=400)
    assert "linked" in done.stdout, done.stderr[-2000:]

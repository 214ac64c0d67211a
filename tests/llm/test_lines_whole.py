"""op2 removes every repeated line, however short, and repeated sentences within lines."""

from pulseloom.llm import lines, queries

SHORT = "All rights reserved."
JOINED = "Short one. Short two. Short three."  # six words, but no sentence of six
LONG = "This sentence of more than six words is repeated."
TEXTS = [
    f"{SHORT}\n{JOINED}\nIntro. {LONG}",
    f"first of its kind\n  all RIGHTS  reserved.\n{JOINED}\n{SHORT}",
    f"Another start. {LONG} An end.\n}}\n}}",
    f"Intro. {LONG}\n{JOINED}",
    None,
    "",
]


def test_whole_lines_and_sentences(spark):
    seen, want = set(), []
    for t in TEXTS:
        out, spans, at = [], [], 0
        for line in (t or "").split("\n"):
            normal = " ".join(line.lower().split())
            if normal and normal in seen:
                spans.append(f"{at}:{at + len(line)}")
                out.append("")
            else:
                keep = line
                if LONG in line:
                    if LONG.lower() in seen:
                        a = at + line.index(LONG)
                        spans.append(f"{a}:{a + len(LONG)}")
                        keep = line.replace(LONG, "")
                    seen.add(LONG.lower())
                out.append(keep)
            seen.add(normal)
            at += len(line) + 1
        want.append((",".join(spans), None if t is None else "\n".join(out)))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = lines.remove_repeats(docs, unit=lines.BOTH).orderBy("doc_id").collect()
    assert [(",".join(f"{s.start}:{s.stop}" for s in r.removed), r.kept_text) for r in got] == want
    assert want[3][0] and want[1][0].count(":") == 3


def test_query_leaves_no_repeated_line(spark):
    from collections import Counter

    from tests.conftest import SF

    left = Counter(" ".join(x.lower().split()) for r in queries.op2_lines(spark, SF).collect() for x in (r.kept_text or "").split("\n"))
    texts = Counter(" ".join(x.lower().split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for x in (r.text or "").split("\n"))
    assert max(texts.values()) > 1 and not [x for x in texts if x and texts[x] > 1 and left[x] > 1]

import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, `group` int, class string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def corpus(seed: int, docs: int = 60) -> list[tuple]:
    """Texts with copies, near copies, shared passages and lines, blanks and nulls."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + [f"rare{i}" for i in range(400)] + ["The", "é", "日本", "x\x0by"]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passage, line = words(30), " ".join(words(6))
    out: list[str | None] = [None, "", " \n\t ", "one", "two words", "a b c", "a b c", "the same of it", "  lead and   trail \r\n\n"]
    while len(out) < docs:
        kind = rnd.randrange(6)
        if kind == 0 and len(out) > 12:
            out.append(rnd.choice(out))
        elif kind == 1 and len(out) > 12 and (base := rnd.choice(out)):
            w = base.split(" ")
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            out.append(" ".join(w))
        elif kind == 2:
            out.append(" ".join(words(rnd.randrange(20)) + passage + words(rnd.randrange(20))))
        else:
            lines = [" ".join(words(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 12))]
            if rnd.random() < 0.5:
                lines[rnd.randrange(len(lines))] = line
                lines.insert(rnd.randrange(len(lines)), line)
            out.append("\n".join(lines))
    out.append(" ".join(words(3000)))
    return [(i, t) for i, t in enumerate(out)]


def frame(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, None, None, "r", 1, 2, "c") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(params=[1, 2])
def rows(request):
    return corpus(request.param)


def words(t):
    return WORD.findall(t or "")

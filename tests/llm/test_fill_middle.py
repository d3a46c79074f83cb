import hashlib
import random
import re

from ratingloom.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text):
    """The transformation over a list of units, by the words of its contract."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digits = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:x], units[x:y], units[y:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(2)
    letters = "ab<>PSM \n\té\x00\x0e\x1f  \U0001f600"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]
    odd = [None, "", " ", "\n\n", "x", " x", "x ", "has <P> inside", "<S>", "a <M", "< S>", "P> <", "word " * 40_000]
    return odd + made


def test_every_rank_of_the_skip_list():
    for text in texts():
        units = UNIT.findall(text or "")
        lanes = M.SkipList(M.unit_ends(text or ""))
        assert lanes.size == len(units)
        ends = [0]
        for u in units:
            ends.append(ends[-1] + len(u))
        ranks = range(len(ends)) if len(ends) < 200 else [*range(0, len(ends), 997), len(ends) - 1]
        assert all(lanes.chars_before(r) == ends[r] for r in ranks)


def test_lanes_carry_both_widths():
    lanes = M.SkipList(M.unit_ends("some more words " * 3000)).lanes
    assert len(lanes) > 4
    for units, chars, _ in lanes:
        assert units.sum() <= 9001 and (units > 0).all() and (chars > 0).all()
    assert [len(u) for u, _, _ in lanes] == sorted((len(u) for u, _, _ in lanes), reverse=True)
    for (units, chars, down), (below, below_chars, _) in zip(lanes[1:], lanes):
        assert (units.cumsum() == below.cumsum()[down]).all() and (chars.cumsum() == below_chars.cumsum()[down]).all()


def test_against_plain_and_back(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "a null id\n"), (7, "same id"), (7, "same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = M.fill_in_middle(docs)
    assert sorted((tuple(r) for r in made.collect()), key=str) == sorted(((k, *plain(k, t)) for k, t in rows), key=str)
    back = made.select("doc_id", M.restored(made["output"], made["form"]).alias("back")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((k, t or "") for k, t in rows), key=str)
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}


def test_digests_are_of_the_whole_texts(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    found = M.digests(M.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))).collect()

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for r in found:
        text = rows[r["doc_id"]][1]
        assert r["restored_sha256"] == sha(text or "") and r["output_sha256"] == sha(plain(r["doc_id"], text)[4])


def test_empty_table_and_clashing_names(spark):
    names = "doc_id int, text string, n int, form string, output string, prefix_chars string"
    assert M.digests(M.fill_in_middle(spark.createDataFrame([], names))).count() == 0
    rows = [(i, f"some text number {i} here", -1, "x", "y", "z") for i in range(20)]
    found = M.fill_in_middle(spark.createDataFrame(rows, names))
    assert found.schema["doc_id"].dataType.simpleString() == "int"
    assert sorted(map(tuple, found.collect())) == sorted((i, *plain(i, t)) for i, t, *_ in rows)

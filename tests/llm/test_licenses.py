import textwrap

import pytest

from quernstone.llm import licenses as L
from quernstone.llm._common import ship

PROSE = "The river runs through the old town. People walk along it in the evening. "


@pytest.mark.parametrize("name,text", [(n, t) for n, texts in L.TEMPLATES.items() for t in texts])
def test_exact_wording_is_confirmed(name, text):
    found = L.classify(text)
    assert (found["license"], found["verdict"], found["share"]) == (name, "exact", 1.0)


def test_small_changes_are_listed():
    found = L.classify("This work is licenced under the GNU General Public License, version 3.")
    assert (found["license"], found["verdict"], found["missing"], found["instead"]) == ("GPL-3.0", "changed", ["licensed"], ["licenced"])
    assert L.classify("This work is licensed under the GNU General Public License, version 7.")["license"] is None


def test_keywords_in_prose_are_unknown():
    assert L.classify("He lost his driving license on the way home from the harbour.")["verdict"] == "unknown"


def test_ranking_matches_plain_sizes():
    """The rank is by how much smaller a raw dictionary makes the block."""
    import zstandard

    block = "Released under the MIT License."
    ranked = L.rank(block, L.TEMPLATES)
    params = zstandard.ZstdCompressionParameters.from_level(L.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    size = lambda d: len(zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress(block.encode()))
    for reduction, _, t in ranked[:5] + ranked[-5:]:
        raw = zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        assert reduction == pytest.approx(1 - size(raw) / size(None))
    assert ranked == sorted(ranked, key=lambda x: (-x[0], x[1], x[2])) and ranked[0][1] == "MIT"


def test_whole_texts_are_scanned(spark):
    ship(spark)
    text = PROSE * 3000 + "Released under the MIT License. " + PROSE + "\nAll rights reserved.\n" + PROSE
    rows = L.scan(spark.createDataFrame([(1, text, "own"), (2, PROSE, ""), (3, None, None), (4, "", "")], "doc_id long, text string, license string")).collect()
    assert sorted((r["doc_id"], r["license"], text[r["start"] : r["start"] + r["chars"]]) for r in rows) == [
        (1, "MIT", "Released under the MIT License."), (1, "all-rights-reserved", "All rights reserved."),
    ]


@pytest.mark.parametrize("mark,end", [("", ""), ("# ", ""), (" * ", ""), ("// ", ""), ("/* ", " */")])
@pytest.mark.parametrize("name,text", [(n, t) for n, texts in L.TEMPLATES.items() for t in texts])
def test_wrapped_notices_are_whole(name, text, mark, end):
    lines = [f"{mark}{x}{end}" for width in (70, 30) for x in [*textwrap.wrap(text, width), ""]]
    whole = "\n".join(["import os", "", *lines, "x = 1  # the river runs through the old town", ""])
    found = [L.classify(L.unwrapped(L.unmarked(whole)[a:b])) for a, b in L.blocks(whole)]
    assert [(f["license"], f["verdict"]) for f in found] == [(name, "exact")] * 2


def test_wrapped_notice_is_found_by_scan(spark):
    ship(spark)
    text = "\n".join("# " + x for x in textwrap.wrap(PROSE + L.TEMPLATES["MIT"][2] + ". " + PROSE, 70))
    r = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(x["license"], x["share"]) for x in r] == [("MIT", 1.0)] and text[r[0]["start"] :].startswith("Permission")


def test_keywords_may_be_wrapped(spark):
    ship(spark)
    r = L.scan(spark.createDataFrame([(1, "# This work is in the public\n# domain.")], "doc_id long, text string")).collect()
    assert [(x["license"], x["verdict"]) for x in r] == [("public-domain", "exact")]


def test_paragraphs_end_blocks():
    text = "The river\n\nAll rights reserved\n\nruns through the town"
    assert [text[a:b] for a, b in L.blocks(text)] == ["All rights reserved"]


@pytest.mark.parametrize("gap", [" ", "\n"])
def test_every_licence_of_a_block_has_a_row(spark, gap):
    ship(spark)
    one = {"MIT": "Released under the MIT License.", "CC-BY-4.0": "Licensed under CC BY 4.0.", "GPL-3.0": L.TEMPLATES["GPL-3.0"][0], "BSD": "Released under the BSD License.", "CC0-1.0": "Released under CC0 1.0."}
    rows = L.scan(spark.createDataFrame([(1, gap.join(list(one.values())[:2])), (2, gap.join(one.values()))], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"], r["verdict"]) for r in rows) == sorted([(1, "MIT", "exact"), (1, "CC-BY-4.0", "exact"), *((2, n, "exact") for n in one)])


def test_notices_that_overlap_are_one():
    assert [x["license"] for x in L.classify_all(L.TEMPLATES["Apache-2.0"][1])] == ["Apache-2.0"]
    assert [x["license"] for x in L.classify_all(L.TEMPLATES["LGPL-3.0"][0])] == ["LGPL-3.0"]


def test_a_long_line_of_keywords_takes_time_in_proportion(spark):
    """One line of 5 MB with 100,000 keywords."""
    import time

    line = "".join(f"The driving license number {k} was lost near the harbour. " for k in range(100_000))[:5_000_000]
    began = time.perf_counter()
    found = L.blocks(line)
    assert time.perf_counter() - began < 5 and len(found) == 1
    took = []
    for n in (500_000, 1_000_000):
        began = time.perf_counter()
        assert [x["verdict"] for x in L.classify_all(line[:n])] == ["unknown"]
        took.append(time.perf_counter() - began)
    assert took[1] < 3 * took[0] + 0.5 and took[1] < 5


def test_every_notice_of_a_long_block_is_found():
    """Thousands of notices, word for word and changed, in one block: where windows end makes no difference."""
    exact, changed = "Released under the MIT License. ", "This work is licenced under the GNU General Public License, version 3. "
    filler = "His driving license number {} was lost. "
    text = "".join(exact + filler.format(k) + (changed if k % 3 == 0 else "") + filler.format(k) * (k % 7) for k in range(900))
    assert len(L.blocks(text)) == 1
    found = L.classify_all(text)
    assert sum(x["license"] == "MIT" and x["verdict"] == "exact" for x in found) == 900
    assert sum(x["license"] == "GPL-3.0" and x["verdict"] == "changed" for x in found) == 300 and len(found) == 1200


@pytest.mark.parametrize("text", [" " * 200_000 + "license", "#" * 200_000 + "x license", "license " + "*" * 200_000 + "/x", "\n" * 200_000 + "license", "license" + " \t" * 100_000 + ".", "/* license " + "- " * 100_000, "all " + "- " * 100_000 + "rights"])
def test_marks_and_blanks_take_no_long(text):
    import time

    began = time.perf_counter()
    assert len(L.unmarked(text)) == len(text) and len(L.blocks(text)) <= 1
    assert time.perf_counter() - began < 2


def old_unmarked(text):
    import re

    mark = re.compile(r"^[^\S\n]*(?:<!--+|/{2,}|/?\*+/?|#+|;+|--+|%+|>+|\"{3}|'{3})[^\S\n]*|[^\S\n]*(?:\*+/|--+>|#+|\*+)[^\S\n]*$", re.MULTILINE)
    return mark.sub(lambda m: " " * len(m[0]), text)


def test_marks_match_their_expression():
    import random

    rnd = random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choices("#*/->< \t\n;%\"'!ab", k=rnd.randint(0, 14)))
        assert L.unmarked(text) == old_unmarked(text), repr(text)


def brute(text):
    """Keyword sentences of one-line texts, joined where adjacent, and every template at every place of them, by hand."""
    import re
    from difflib import SequenceMatcher

    ends = [m.end() for m in re.finditer(r"[.!?](?=\s|$)(?!\s+\d)", text)]
    cuts = [0, *ends] + ([len(text)] if not ends or ends[-1] < len(text) else [])
    sentences = [(a, b) for a, b in zip(cuts, cuts[1:]) if text[a:b].strip()]
    runs = []
    for a, b in sentences:
        if not re.search(L.KEYWORDS, text[a:b], re.IGNORECASE):
            runs.append(None)
        elif runs and runs[-1]:
            runs[-1] += text[a:b]
        else:
            runs.append(text[a:b])
    out = []
    for run in filter(None, runs):
        words = [w.lower() for w in re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", run)]
        found = []
        while True:
            best = None
            for name, texts in L.TEMPLATES.items():
                for t in texts:
                    own = [w.lower() for w in re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", t)]
                    codes = SequenceMatcher(None, own, words, autojunk=False).get_opcodes()
                    equal = sum(b - a for op, a, b, _, _ in codes if op == "equal")
                    if equal < 0.8 * len(own):
                        continue
                    missing = [w for op, a, b, _, _ in codes if op != "equal" for w in own[a:b]]
                    instead = [w for op, _, _, c, d in codes[1:-1] if op != "equal" for w in words[c:d]]
                    if len(missing) + len(instead) > max(1, 0.34 * len(own)):
                        continue
                    if (missing or instead) and (any(c.isdigit() for w in missing for c in w) or {*missing, *instead} & L._TELLING):
                        continue
                    exact = not missing and not instead
                    key = (equal / len(own), len(own) if exact else 0)
                    if best is None or key > best[0]:
                        best = (key, name, "exact" if exact else "changed", [k for op, _, _, c, d in codes if op == "equal" for k in range(c, d)])
            if best is None:
                break
            found.append((best[1], best[2]))
            for k in best[3]:
                words[k] = None
        out += found or [(None, "unknown")]
    return sorted(out, key=str)


def test_scan_matches_brute_force(spark):
    """Every document of a fixture: notices of every licence, whole, changed and cut, alone and in runs, among prose with keywords."""
    import random

    ship(spark)
    rnd = random.Random(11)
    notices = [t for texts in L.TEMPLATES.values() for t in texts if t.endswith(".")]
    rows = []
    for k in range(150):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            t = rnd.choice(notices)
            words = t.split(" ")
            if rnd.random() < 0.4 and len(words) > 6:
                words[rnd.randrange(1, len(words) - 1)] = rnd.choice(["fully", "herewith"])
            if rnd.random() < 0.1:
                words = words[: len(words) // 2] + ["license."]
            parts += [" ".join(words)] + rnd.choice([[], [PROSE.strip()], ["He lost his driving license."], [PROSE.strip() * 3]])
        rows.append((k, " ".join(parts)))
    found = {}
    for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], []).append((r["license"], r["verdict"]))
    for k, text in rows:
        assert sorted(found.get(k, []), key=str) == brute(text), text

"""Claims of Markdown texts against a line-by-line reading."""

import random
import re

from brindle.operators import markdown

PIECES = ["Plain words that say one thing.", "Two things here. And e.g. More of it, see Fig. 3 there! Then", "short", "- a bullet that says a thing", "1. a number that says a thing", "> quoted words of a line", "", "", "# One", "## 2. References", "### References of all", "#", "```", "<!-- a remark -->", "| a | b |", "| --- | :-: |", "| c | |", "|| d | e | f ||", "|", "![alt text](x.png) after", "![](y.png)", "**Figure 2.** What it shows", "**Table** of all", "---", "  indented words of a line  ", "* star (Bracket follows here). (Next one is here)"]
APPENDIX = "<!-- sidecar: x sha256=" + "a" * 64 + " -->"


def plain(text):
    lines = [line.strip() for line in text.split("\n")]
    at = 0
    if lines[0] == "---":
        at = next((k for k, s in enumerate(lines) if k and s == "---"), 0) + 1
    found, heading, code, prose, table = [], "", False, [], []

    def sentences(par):
        held = re.sub(rf"(?i)\b({'|'.join(markdown.ABBREVIATIONS)})\.", "\\1\u2024", par)
        return [p for p in (x.replace("\u2024", ".").strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z(\[*])", held)) if p]

    def close(what):
        if "p" in what and prose:
            for k, sentence in enumerate(sentences(" ".join(t for _, _, t in prose))):
                if len(re.findall("[A-Za-z]{2,}", sentence)) >= 3:
                    found.append((prose[-1][0], k, "prose", prose[0][1], sentence))
            prose.clear()
        if "t" in what and table:
            cells = [[c.strip() for c in s.strip("|").split("|")] for _, _, s in table]
            for k, row in enumerate(cells[1:]):
                if not all(re.fullmatch(":?-{2,}:?", c) for c in row):
                    found.append((table[-1][0], k, "table", table[0][1], "; ".join(f"{h}: {c}" for h, c in zip(cells[0], row) if c)))
            table.clear()

    for k, s in list(enumerate(lines))[at:]:
        if s == APPENDIX:
            break
        if s.startswith("```"):
            code = not code
        elif code or s.startswith("<!--"):
            continue
        elif s.startswith("|"):
            close("p")
            table.append((k, heading, s))
        else:
            close("t")
            if s.startswith("#"):
                close("p")
                heading = s.lstrip("#").strip()
            elif re.match(r"(?i)(\d+\.?\s*)?(references|bibliography)\b", heading):
                continue
            elif not s:
                close("p")
            elif m := re.match(r"!\[([^\]]*)\]\([^)]*\)", s):
                close("p")
                found += [(k, 0, "caption", heading, m[1].strip())] if m[1].strip() else []
            elif re.match(r"\*\*(Figure|Table)\s*\d*\.?\*\*", s):
                close("p")
                found.append((k, 0, "caption", heading, s.replace("**", "")))
            else:
                prose.append((k, heading, re.sub(r"^[-*>]\s+|^\d+\.\s+", "", s)))
    close("pt")
    return found


def test_units_of_random_texts(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(PIECES) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    texts += [t + "\n" + APPENDIX + "\nWords that are not kept here." for t in texts[:30]] + ["---\n" + t for t in texts[:40]] + ["", "---", "---\n---\nWords that are kept here."]
    df = spark.createDataFrame([*enumerate(texts), (9999, None)], "i long, t string")
    got: dict = {}
    for r in markdown.units(df, "i", "t").collect():
        got.setdefault(r.id, []).append((r["at"], r.part, r.kind, r.location, r.text))
    kinds = set()
    for k, text in enumerate(texts):
        wanted = plain(text)
        kinds |= {u[2] for u in wanted}
        assert sorted(got.get(k, [])) == sorted(wanted), text
    assert kinds == {"prose", "table", "caption"} and 9999 not in got


def test_html_units(spark, tmp_path):
    from brindle.plans import registry

    page = "<html><script>var p = '<p>no</p>'</script><h1>A  title</h1><p class=x>One <b>bold</b>\nword</p><!-- <p>none</p> --><ul><li>item</li><li> </li></ul><table><tr><td>cell</td></tr></table>"
    spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = registry.queries()["html_to_units"](spark, str(tmp_path)).collect()
    assert [(r.page_id, r.unit, r.tag, r.text) for r in sorted(rows, key=lambda r: r.unit)] == [(1, 0, "h1", "A title"), (1, 1, "p", "One bold word"), (1, 2, "li", "item"), (1, 4, "td", "cell")]

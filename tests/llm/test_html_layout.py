"""Tables against a plain grid, and pages that would be slow with work that grows by squares."""

import random
import time

from tidelog.llm import html_render


def grid_layout(rows):
    """Cell by cell on a grid of (row, column); widths by looking at every cell."""
    owner, at = {}, {}
    for r, row in enumerate(rows):
        c = 0
        for n, (_, across, down) in enumerate(row):
            while (r, c) in owner:
                c += 1
            at[r, n] = c
            for y in range(r, r + down):
                for x in range(c, c + across):
                    owner[y, x] = (r, n)
            c += across
    used = sorted({at[r, n] for r, row in enumerate(rows) for n, (lines, _, _) in enumerate(row) if any(lines)})
    wide = {c: max([min(html_render.WIDE, max(map(len, lines), default=0)) for r, row in enumerate(rows) for n, (lines, across, _) in enumerate(row) if across == 1 and at[r, n] == c], default=0) for c in used}
    out = []
    for r, row in enumerate(rows):
        cells = {at[r, n]: (lines, across) for n, (lines, across, _) in enumerate(row)}
        for k in range(max((len(lines) for lines, _, _ in row), default=0)):
            parts, covered = [], -1
            for c in used:
                if c >= covered:
                    lines, across = cells.get(c, ([], 1))
                    covered = c + across
                    inside = [wide[x] for x in used if c <= x < covered]
                    parts.append((lines[k] if k < len(lines) else "").ljust(sum(inside) + 3 * len(inside) - 3))
            while parts and not parts[-1].strip():
                parts.pop()
            out.append(" | ".join(parts).rstrip(" "))
    return out


def test_random_tables():
    draw = random.Random(9)
    for _ in range(400):
        cell = lambda: ([draw.choice(["", "a", "some text", "|", "x" * 70]) for _ in range(draw.choice([0, 1, 1, 1, 2]))], draw.choice([1, 1, 1, 2, 3]), draw.choice([1, 1, 1, 2, 3]))
        rows = [[cell() for _ in range(draw.randrange(1, 5))] for _ in range(draw.randrange(1, 6))]
        assert html_render.lay_out(rows) == grid_layout(rows)


def test_no_text_is_lost_without_padding():
    rows = [[([f"cell {k}", "" if k % 2 else "more"], 1, 1000)] for k in range(500)] + [[([], 1, 1), (["last"], 9, 1)]]
    assert [x for x in html_render.lay_out(rows) if x] == [x for k in range(500) for x in ([f"cell {k}"] if k % 2 else [f"cell {k}", "more"])] + ["last"]


def test_time_follows_the_length():
    pages = {
        "rowspans": "<table>" + "<tr><td rowspan=1000>a" * 4000 + "</table>",
        "colspans": "<table>" + ("<tr>" + "<td colspan=1000>a" * 3) * 4000 + "</table>",
        "equal rules": "<style>" + ".d{display:none}\n" * 4000 + "</style>" + "<p class=d>x</p><p>a</p>" * 4000,
        "rules for all": "<style>" + "p{visibility:visible} .d p{display:block}\n" * 4000 + "</style>" + "<p>a</p>" * 4000,
    }
    for name, page in pages.items():
        began = time.perf_counter()
        text = html_render.render(page)
        assert time.perf_counter() - began < 5, name
        assert text.count("a") >= 4000 and "x" not in text


def test_stronger_declarations():
    page = "<style>.a{display:none} .a{display:block} #i{visibility:hidden} .b{display:none !important} .b{display:block} .c:unknown{display:block} .c{display:none}</style>"
    text = html_render.render(page + "<p class=a>one</p><p id=i>two</p><p class=b>three</p><p class=c>four</p><p class='a b'>five</p><p class=b style='display:block'>six</p>")
    assert text.split() == ["one", "four"]

"""One text template per diagram type, as native column expressions.

A template maps the draws of a row to a string column. To add a type, write one
function under ``@template``; the corpus, fixed set, stream and contract check
pick it up from ``TEMPLATES``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.draws import Draws, cat, let, lines, listed, upto
from glyphmill.plans.vocabulary import NEGATIVE_WORDS, Words

Template = Callable[[Draws, Words], Column]
TEMPLATES: dict[str, Template] = {}


def template(name: str) -> Callable[[Template], Template]:
    def register(fn: Template) -> Template:
        TEMPLATES[name] = fn
        return fn

    return register


def label(d: Draws, w: Words, *slot) -> Column:
    return d.choices(w.verbs, w.nouns, " ", *slot)


def capital(word: Column) -> Column:
    return cat(F.upper(F.left(word, F.lit(1))), F.lower(F.substr(word, F.lit(2))))


def starts(widths: Column, first: int, body: Callable[[Column, Column], Column]) -> Column:
    """``body(start_i, width_i)`` where start_i is ``first`` plus the widths before i."""
    return F.transform(
        widths,
        lambda width, i: body(
            F.aggregate(F.slice(widths, 1, i), F.lit(first), lambda a, b: a + b), width
        ),
    )


def boxed(kind: Column, text: Column) -> Column:
    opening = F.when(kind == "terminal", "([").when(kind == "decision", "{").when(kind == "io", "[/").otherwise("[")
    closing = F.when(kind == "terminal", "])").when(kind == "decision", "}").when(kind == "io", "/]").otherwise("]")
    return cat(opening, '"', text, '"', closing)


@template("flowchart")
def flowchart(d: Draws, w: Words) -> Column:
    weights = [("process", 12), ("decision", 2), ("io", 1)]

    def draw_all(n: Column) -> Column:
        kinds = upto(n, 9, lambda i: F.when((i == 0) | (i == n - 1), "terminal").otherwise(d.weighted(weights, "kind", i)))

        def text(kinds: Column) -> Column:
            nodes = F.transform(
                kinds,
                lambda kind, i: cat(
                    "    N", i,
                    boxed(kind, F.when(i == 0, "Start").when(i == n - 1, "End").otherwise(label(d, w, "node", i))),
                ),
            )
            edges = upto(
                n - 1, 8,
                lambda i: F.when(
                    (F.get(kinds, i) == "decision") & (i + 2 < n),
                    cat(
                        "    N", i, " -->|Yes| N", i + 1, "\n",
                        "    N", i, " -->|No| N", i + 2 + d.below(n - i - 2, "skip", i),
                    ),
                ).otherwise(cat("    N", i, " --> N", i + 1)),
            )
            return lines("flowchart TD", nodes, edges)

        return let(kinds, text)

    return let(d.randint(4, 9, "n"), draw_all)


@template("swimlanes")
def swimlanes(d: Draws, w: Words) -> Column:
    return let(
        d.randint(3, 6, "n"),
        lambda n: lines(
            "flowchart TD",
            upto(n, 6, lambda i: cat("    N", i, '["', label(d, w, "node", i), '"]')),
            upto(n - 1, 5, lambda i: cat("    N", i, " --> N", i + 1)),
        ),
    )


@template("sequence")
def sequence(d: Draws, w: Words) -> Column:
    cast = ["Alice", "Bob", "Carol", "Server", "Client", "DB", "Cache"]

    def message(actors: Column, i: Column) -> Column:
        arrow = d.choice(["->>", "-->>"], "arrow", i)
        text = label(d, w, "message", i)
        return d.two_of(actors, lambda a, b: cat("    ", a, arrow, b, ": ", text), "pair", i)

    return let(
        d.sample(cast, d.randint(2, 4, "k"), "actor"),
        lambda actors: lines("sequenceDiagram", upto(d.randint(3, 7, "n"), 7, lambda i: message(actors, i))),
    )


@template("class_diagram")
def class_diagram(d: Draws, w: Words) -> Column:
    def relation(names: Column, i: Column) -> Column:
        kind = d.choice(["<|--", "*--", "o--", "-->"], "relation", i)
        return d.two_of(names, lambda a, b: cat("    ", a, " ", kind, " ", b), "pair", i)

    return let(
        upto(d.randint(2, 5, "k"), 5, lambda i: cat("Class", i)),
        lambda names: lines(
            "classDiagram",
            F.transform(names, lambda c: cat("    class ", c)),
            upto(d.below(F.size(names) - 1, "n") + 1, 4, lambda i: relation(names, i)),
        ),
    )


@template("state_diagram")
def state_diagram(d: Draws, w: Words) -> Column:
    return let(
        d.randint(2, 5, "k"),
        lambda k: lines(
            "stateDiagram-v2",
            "    [*] --> State0",
            upto(k - 1, 4, lambda i: cat("    State", i, " --> State", i + 1)),
            cat("    State", k - 1, " --> [*]"),
        ),
    )


@template("er_diagram")
def er_diagram(d: Draws, w: Words) -> Column:
    def relation(names: Column, i: Column) -> Column:
        kind = d.choice(["||--o{", "||--|{", "}o--o{"], "relation", i)
        verb = F.lower(d.choice(w.verbs, "verb", i))
        return d.two_of(names, lambda a, b: cat("    ", a, " ", kind, " ", b, " : ", verb, "s"), "pair", i)

    return let(
        F.transform(d.sample(w.nouns, d.randint(2, 4, "k"), "entity"), F.upper),
        lambda names: lines("erDiagram", upto(d.below(F.size(names) - 1, "n") + 1, 3, lambda i: relation(names, i))),
    )


@template("journey")
def journey(d: Draws, w: Words) -> Column:
    titles = ["My day", "Onboarding flow", "Shopping trip"]
    parts = ["Morning", "Afternoon", "Evening", "Checkout", "Setup"]

    def section(i: Column) -> Column:
        return lines(
            cat("    section ", d.choice(parts, "section", i)),
            upto(
                d.randint(2, 4, "tasks", i), 4,
                lambda j: cat("      ", label(d, w, "task", i, j), ": ", d.randint(1, 5, "score", i, j), ": Me"),
            ),
        )

    return lines("journey", cat("    title ", d.choice(titles, "title")), upto(d.randint(2, 3, "n"), 3, section))


@template("gantt")
def gantt(d: Draws, w: Words) -> Column:
    def tasks(days: Column) -> Column:
        spans = starts(days, 1, lambda day, width: cat("2024-01-", F.lpad(day, 2, "0"), ", ", width, "d"))
        return F.transform(spans, lambda span, i: cat("    ", label(d, w, "task", i), ": ", span))

    return lines(
        "gantt", "    title Project Plan", "    dateFormat YYYY-MM-DD", "    section Phase 1",
        let(upto(d.randint(2, 5, "n"), 5, lambda i: d.randint(2, 6, "days", i)), tasks),
    )


@template("pie")
def pie(d: Draws, w: Words) -> Column:
    titles = ["Distribution", "Breakdown", "Share of total"]
    slices = d.sample(w.nouns, d.randint(3, 6, "n"), "slice")
    return lines(
        cat("pie title ", d.choice(titles, "title")),
        F.transform(slices, lambda s, i: cat('    "', s, '" : ', d.randint(5, 100, "value", i))),
    )


@template("quadrant")
def quadrant(d: Draws, w: Words) -> Column:
    return lines(
        "quadrantChart",
        cat("    title ", d.choice(["Reach vs Engagement", "Effort vs Impact"], "title")),
        "    x-axis Low --> High",
        "    y-axis Low --> High",
        upto(
            d.randint(3, 6, "n"), 6,
            lambda i: cat(
                "    ", capital(d.choice(w.nouns, "point", i)),
                ": [", d.hundredths("x", i), ", ", d.hundredths("y", i), "]",
            ),
        ),
    )


@template("requirement")
def requirement(d: Draws, w: Words) -> Column:
    def block(i: Column) -> Column:
        return lines(
            cat("    requirement req", i, " {"),
            cat("        id: ", i + 1),
            cat("        text: ", label(d, w, "text", i)),
            cat("        risk: ", d.choice(["low", "medium", "high"], "risk", i)),
            cat("        verifymethod: ", d.choice(["test", "analysis", "inspection"], "method", i)),
            "    }",
        )

    return lines(
        "requirementDiagram", upto(d.randint(1, 3, "n"), 3, block),
        "    element elem0 {", "        type: simulation", "    }", "    elem0 - satisfies -> req0",
    )


@template("gitgraph")
def gitgraph(d: Draws, w: Words) -> Column:
    def branch(i: Column) -> Column:
        commits = upto(d.randint(1, 3, "commits", i), 3, lambda j: F.lit("    commit"))
        return lines(cat("    branch feature", i), commits, "    checkout main", cat("    merge feature", i))

    return lines("gitGraph", "    commit", upto(d.randint(1, 2, "n"), 2, branch))


@template("c4")
def c4(d: Draws, w: Words) -> Column:
    return let(
        d.randint(1, 2, "n"),
        lambda n: lines(
            "C4Context",
            cat('    Person(user, "', d.choice(["User", "Admin", "Customer"], "person"), '")'),
            upto(n, 2, lambda i: cat("    System(sys", i, ', "', label(d, w, "system", i), '")')),
            '    Rel(user, sys0, "Uses")',
            upto(n - 1, 1, lambda i: cat("    Rel(sys", i, ", sys", i + 1, ', "Calls")')),
        ),
    )


@template("mindmap")
def mindmap(d: Draws, w: Words) -> Column:
    def child(i: Column) -> Column:
        return lines(
            cat("    ", d.choice(w.nouns, "child", i), i),
            upto(d.randint(0, 2, "leaves", i), 2, lambda j: cat("      ", d.choice(w.nouns, "leaf", i, j), i, j)),
        )

    return lines("mindmap", "  Root", upto(d.randint(2, 4, "n"), 4, child))


@template("timeline")
def timeline(d: Draws, w: Words) -> Column:
    def rows(gaps: Column) -> Column:
        years = starts(gaps, 0, lambda years, _: d.randint(2018, 2023, "start") + years)
        return F.transform(years, lambda year, i: cat("    ", year, " : ", label(d, w, "row", i)))

    return lines(
        "timeline", cat("    title ", d.choice(["Company History", "Project Milestones"], "title")),
        let(upto(d.randint(3, 5, "n"), 5, lambda i: d.randint(1, 2, "gap", i)), rows),
    )


@template("sankey")
def sankey(d: Draws, w: Words) -> Column:
    return let(
        d.sample(w.nouns, d.randint(3, 5, "n"), "node"),
        lambda nodes: lines(
            "sankey-beta", "",
            upto(
                F.size(nodes) - 1, 4,
                lambda i: cat(F.get(nodes, i), ",", F.get(nodes, i + 1), ",", d.randint(5, 50, "value", i)),
            ),
        ),
    )


@template("xychart")
def xychart(d: Draws, w: Words) -> Column:
    months = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul"]

    def chart(values: Column) -> Column:
        shown = F.transform(d.sample(months, F.size(values), "month"), lambda m: cat('"', m, '"'))
        return lines(
            "xychart-beta",
            cat('    title "', d.choice(["Sales", "Revenue", "Usage"], "title"), '"'),
            cat("    x-axis [", F.array_join(shown, ", "), "]"),
            cat('    y-axis "Value" 0 --> ', F.array_max(values) + 20),
            cat("    bar [", F.array_join(values.cast("array<string>"), ", "), "]"),
        )

    return let(upto(d.randint(3, 6, "n"), 6, lambda i: d.randint(10, 100, "value", i)), chart)


@template("block")
def block(d: Draws, w: Words) -> Column:
    letters = F.slice(listed("abcdef"), 1, d.randint(3, 6, "n"))
    return lines("block-beta", cat("    columns ", d.randint(2, 3, "columns")), cat("    ", F.array_join(letters, " ")))


@template("packet")
def packet(d: Draws, w: Words) -> Column:
    def fields(widths: Column) -> Column:
        ranges = starts(widths, 0, lambda bit, width: cat(bit, "-", bit + width - 1))
        return F.transform(ranges, lambda bits, i: cat("    ", bits, ': "', d.choice(w.nouns, "field", i), '"'))

    return lines(
        "packet-beta", cat("    title ", d.choice(["Packet", "Header"], "title")),
        let(upto(d.randint(2, 4, "n"), 4, lambda i: d.choice([8, 16], "width", i)), fields),
    )


@template("kanban")
def kanban(d: Draws, w: Words) -> Column:
    columns = d.sample(["Todo", "Doing", "Review", "Done"], d.randint(2, 4, "n"), "column")
    return lines(
        "kanban",
        F.transform(
            columns,
            lambda name, i: lines(
                cat("    ", name),
                upto(
                    d.randint(1, 3, "tasks", i), 3,
                    lambda j: cat("        task", name, j, "[", label(d, w, "task", i, j), "]"),
                ),
            ),
        ),
    )


@template("architecture")
def architecture(d: Draws, w: Words) -> Column:
    return lines(
        "architecture-beta", "    group api(cloud)[API]",
        upto(
            d.randint(2, 3, "n"), 3,
            lambda i: cat(
                "    service svc", i, "(", d.choice(["server", "database", "disk"], "icon", i), ")[",
                label(d, w, "service", i), "] in api",
            ),
        ),
    )


@template("radar")
def radar(d: Draws, w: Words) -> Column:
    def chart(axes: Column) -> Column:
        named = F.transform(axes, lambda a: cat(F.left(a, F.lit(3)), '["', a, '"]'))

        def curve(name: str) -> Column:
            values = upto(F.size(axes), 5, lambda i: d.randint(1, 100, "curve", name, i).cast("string"))
            return cat("    curve ", name, '["', name, '"]{', F.array_join(values, ", "), "}")

        return lines(
            "radar-beta", cat("    title ", d.choice(["Comparison", "Scores"], "title")),
            cat("    axis ", F.array_join(named, ", ")), curve("A"), curve("B"), "    max 100", "    min 0",
        )

    return let(d.sample(w.nouns, d.randint(3, 5, "n"), "axis"), chart)


@template("eventmodeling")
def eventmodeling(d: Draws, w: Words) -> Column:
    return lines(
        "eventmodeling",
        upto(
            d.randint(3, 5, "n"), 5,
            lambda i: cat(
                "    tf ", F.lpad(i + 1, 2, "0"), " ", d.choice(["ui", "cmd", "evt"], "kind", i), " ",
                capital(d.choice(w.nouns, "noun", i)), d.choice(w.verbs, "verb", i),
            ),
        ),
    )


@template("treemap")
def treemap(d: Draws, w: Words) -> Column:
    def group(i: Column) -> Column:
        return lines(
            cat('    "', capital(d.choice(w.nouns, "group", i)), '"'),
            upto(
                d.randint(1, 3, "leaves", i), 3,
                lambda j: cat('        "', label(d, w, "leaf", i, j), '": ', d.randint(5, 50, "value", i, j)),
            ),
        )

    return lines("treemap-beta", upto(d.randint(2, 3, "n"), 3, group))


@template("venn")
def venn(d: Draws, w: Words) -> Column:
    sets = F.slice(listed("ABC"), 1, d.randint(2, 3, "n"))
    return lines(
        "venn-beta",
        F.transform(sets, lambda s, i: cat("    set ", s, '["', capital(d.choice(w.nouns, "set", i)), '"]')),
        "    union A,B",
    )


@template("ishikawa")
def ishikawa(d: Draws, w: Words) -> Column:
    bones = d.sample(["Process", "People", "Equipment", "Environment"], d.randint(2, 4, "n"), "category")
    return lines(
        "ishikawa-beta", cat("    ", d.choice(["Problem", "Defect", "Issue"], "problem")),
        F.transform(
            bones,
            lambda bone, i: lines(
                cat("        ", bone),
                upto(d.randint(1, 2, "causes", i), 2, lambda j: cat("            ", label(d, w, "cause", i, j))),
            ),
        ),
    )


@template("wardley")
def wardley(d: Draws, w: Words) -> Column:
    return lines("wardley-beta", cat("    title ", d.choice(["Value Chain", "Map"], "title")))


@template("cynefin")
def cynefin(d: Draws, w: Words) -> Column:
    return lines("cynefin-beta", cat("    title ", d.choice(["Framework", "Decision Map"], "title")))


@template("treeview")
def treeview(d: Draws, w: Words) -> Column:
    return lines(
        "treeView-beta", cat(d.choice(w.nouns, "root"), "-project/"),
        upto(
            d.randint(2, 4, "n"), 4,
            lambda i: lines(
                cat("  ", d.choice(w.nouns, "folder", i), "/"), cat("    ", d.choice(w.nouns, "file", i), ".txt")
            ),
        ),
    )


def negative_text(d: Draws) -> Column:
    """Plain prose for the class that is no diagram."""
    return lines(
        upto(
            d.randint(8, 14, "lines"), 14,
            lambda i: F.array_join(
                upto(d.randint(6, 11, "words", i), 11, lambda j: d.choice(NEGATIVE_WORDS, "word", i, j)), " "
            ),
        )
    )

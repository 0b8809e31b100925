"""The 29 text templates in DuckDB SQL, written apart from the Spark ones.

``G(row, stream, seed)`` holds the SQL of the draws of one generated row.
"""

from __future__ import annotations

from glyphmill.plans import vocabulary as v


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ",".join(text(x) if isinstance(x, str) else str(x) for x in values) + "]"


def u32(*parts) -> str:
    """SQL of a draw; parts are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(str(p) for p in parts)})), 1, 8))::BIGINT)"


def word(number, *parts) -> str:
    """SQL of the numbered 32-bit word of the md5."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(str(p) for p in parts)})), 1 + 8 * ({number}), 8))::BIGINT)"


def cat(*parts) -> str:
    return "concat(" + ", ".join(parts) + ")"


def nl(*parts) -> str:
    """Join SQL string expressions with newlines; L(...) marks list-valued ones."""
    return "array_to_string(" + " || ".join(p if isinstance(p, L) else f"[{p}]" for p in parts) + ", chr(10))"


class L(str):
    """An SQL expression whose value is a list of strings."""


def upto(n, var, body) -> L:
    return L(f"list_transform(range(0, {n}), lambda {var}: {body})")


class G:
    def __init__(self, row: str, stream: str, seed: str = "42", verbs=v.VERBS, nouns=v.NOUNS):
        self.key = (seed, stream, row)
        self.verbs, self.nouns = verbs, nouns

    def u(self, *slot):
        return u32(*self.key, *slot)

    def rnd(self, a, b, *slot):
        return f"({a} + {self.u(*slot)} % {b - a + 1})"

    def pick(self, options, *slot):
        return f"({arr(options)}[{self.u(*slot)} % {len(options)} + 1])"

    def noun(self, *slot):
        return self.pick(self.nouns, *slot)

    def verb(self, *slot):
        return self.pick(self.verbs, *slot)

    def cap(self, *slot):
        x = self.noun(*slot)
        return f"concat(upper({x}[1]), lower({x}[2:]))"

    def label(self, *slot):
        verb = f"({arr(self.verbs)}[{word(0, *self.key, *slot)} % {len(self.verbs)} + 1])"
        noun = f"({arr(self.nouns)}[{word(1, *self.key, *slot)} % {len(self.nouns)} + 1])"
        return cat(verb, "' '", noun)

    def sample(self, options, k, *slot):
        deck = f"list_transform(range(0, {len(options)}), lambda q: {{'d': {word('q % 4', *self.key, *slot, 'q // 4')}, 'i': q, 'x': {arr(options)}[q + 1]}})"
        return L(f"list_transform(list_slice(list_sort({deck}), 1, {k}), lambda s: s.x)")

    def pair(self, names, *slot):
        a = f"({word(0, *self.key, *slot)} % len({names}))"
        b = f"(({a} + 1 + {word(1, *self.key, *slot)} % (len({names}) - 1)) % len({names}))"
        return f"({names}[{a} + 1])", f"({names}[{b} + 1])"


def let(value, var, body) -> str:
    return f"(list_transform([{value}], lambda {var}: {body})[1])"


def flowchart(g: G) -> str:
    point = f"{g.u(chr(39)+'kind'+chr(39), 'i')} % 15"
    kind = f"CASE WHEN i = 0 OR i = n - 1 THEN 'terminal' WHEN {point} < 12 THEN 'process' WHEN {point} < 14 THEN 'decision' ELSE 'io' END"
    name = f"CASE WHEN i = 0 THEN 'Start' WHEN i = n - 1 THEN 'End' ELSE {g.label(chr(39)+'node'+chr(39), 'i')} END"
    k = "ks[i + 1]"
    node = cat(
        "'    N'", "i",
        f"CASE {k} WHEN 'terminal' THEN '([' WHEN 'decision' THEN '{{' WHEN 'io' THEN '[/' ELSE '[' END",
        "'\"'", name, "'\"'",
        f"CASE {k} WHEN 'terminal' THEN '])' WHEN 'decision' THEN '}}' WHEN 'io' THEN '/]' ELSE ']' END",
    )
    skip = f"i + 2 + {g.u(chr(39)+'skip'+chr(39), 'i')} % greatest(n - i - 2, 1)"
    edge = (
        f"CASE WHEN {k} = 'decision' AND i + 2 < n THEN "
        + cat("'    N'", "i", "' -->|Yes| N'", "i + 1", "chr(10)", "'    N'", "i", "' -->|No| N'", skip)
        + " ELSE " + cat("'    N'", "i", "' --> N'", "i + 1") + " END"
    )
    return let(
        g.rnd(4, 9, "'n'"), "n",
        let(upto("n", "i", kind), "ks", nl("'flowchart TD'", upto("n", "i", node), upto("n - 1", "i", edge))),
    )


def swimlanes(g: G) -> str:
    return let(
        g.rnd(3, 6, "'n'"), "n",
        nl(
            "'flowchart TD'",
            upto("n", "i", cat("'    N'", "i", "'[\"'", g.label("'node'", "i"), "'\"]'")),
            upto("n - 1", "i", cat("'    N'", "i", "' --> N'", "i + 1")),
        ),
    )


def sequence(g: G) -> str:
    a, b = g.pair("ac", "'pair'", "i")
    cast = ["Alice", "Bob", "Carol", "Server", "Client", "DB", "Cache"]
    msg = cat("'    '", a, g.pick(["->>", "-->>"], "'arrow'", "i"), b, "': '", g.label("'message'", "i"))
    return let(g.sample(cast, g.rnd(2, 4, "'k'"), "'actor'"), "ac", nl("'sequenceDiagram'", upto(g.rnd(3, 7, "'n'"), "i", msg)))


def class_diagram(g: G) -> str:
    a, b = g.pair("cs", "'pair'", "i")
    rel = cat("'    '", a, "' '", g.pick(["<|--", "*--", "o--", "-->"], "'relation'", "i"), "' '", b)
    return let(
        upto(g.rnd(2, 5, "'k'"), "i", "concat('Class', i)"), "cs",
        nl(
            "'classDiagram'", L("list_transform(cs, lambda c: concat('    class ', c))"),
            upto(f"1 + {g.u(chr(39)+'n'+chr(39))} % (len(cs) - 1)", "i", rel),
        ),
    )


def state_diagram(g: G) -> str:
    return let(
        g.rnd(2, 5, "'k'"), "k",
        nl(
            "'stateDiagram-v2'", "'    [*] --> State0'",
            upto("k - 1", "i", "concat('    State', i, ' --> State', i + 1)"), "concat('    State', k - 1, ' --> [*]')",
        ),
    )


def er_diagram(g: G) -> str:
    a, b = g.pair("es", "'pair'", "i")
    rel = cat(
        "'    '", a, "' '", g.pick(["||--o{", "||--|{", "}o--o{"], "'relation'", "i"), "' '", b, "' : '",
        f"lower({g.verb(chr(39)+'verb'+chr(39), 'i')})", "'s'",
    )
    names = L(f"list_transform({g.sample(g.nouns, g.rnd(2, 4, chr(39)+'k'+chr(39)), chr(39)+'entity'+chr(39))}, lambda e: upper(e))")
    return let(names, "es", nl("'erDiagram'", upto(f"1 + {g.u(chr(39)+'n'+chr(39))} % (len(es) - 1)", "i", rel)))


def journey(g: G) -> str:
    task = cat("'      '", g.label("'task'", "i", "j"), "': '", g.rnd(1, 5, "'score'", "i", "j"), "': Me'")
    section = nl(
        cat("'    section '", g.pick(["Morning", "Afternoon", "Evening", "Checkout", "Setup"], "'section'", "i")),
        upto(g.rnd(2, 4, "'tasks'", "i"), "j", task),
    )
    title = cat("'    title '", g.pick(["My day", "Onboarding flow", "Shopping trip"], "'title'"))
    return nl("'journey'", title, upto(g.rnd(2, 3, "'n'"), "i", section))


def before(widths: str, first: str) -> str:
    """Running sum of the widths before position i."""
    return f"({first} + coalesce(list_sum(list_slice({widths}, 1, i)), 0)::BIGINT)"


def gantt(g: G) -> str:
    row = cat(
        "'    '", g.label("'task'", "i"), "': 2024-01-'", f"printf('%02d', {before('ds', '1')})", "', '", "ds[i + 1]", "'d'"
    )
    return let(
        upto(g.rnd(2, 5, "'n'"), "i", g.rnd(2, 6, "'days'", "i")), "ds",
        nl(
            "'gantt'", "'    title Project Plan'", "'    dateFormat YYYY-MM-DD'", "'    section Phase 1'",
            upto("len(ds)", "i", row),
        ),
    )


def pie(g: G) -> str:
    row = cat("'    \"'", "ss[i + 1]", "'\" : '", g.rnd(5, 100, "'value'", "i"))
    return let(
        g.sample(g.nouns, g.rnd(3, 6, "'n'"), "'slice'"), "ss",
        nl(cat("'pie title '", g.pick(["Distribution", "Breakdown", "Share of total"], "'title'")), upto("len(ss)", "i", row)),
    )


def quadrant(g: G) -> str:
    x, y = (f"printf('%02d', {g.rnd(2, 97, chr(39)+s+chr(39), 'i')})" for s in "xy")
    row = cat("'    '", g.cap("'point'", "i"), "': [0.'", x, "', 0.'", y, "']'")
    return nl(
        "'quadrantChart'", cat("'    title '", g.pick(["Reach vs Engagement", "Effort vs Impact"], "'title'")),
        "'    x-axis Low --> High'", "'    y-axis Low --> High'", upto(g.rnd(3, 6, "'n'"), "i", row),
    )


def requirement(g: G) -> str:
    part = nl(
        "concat('    requirement req', i, ' {')", "concat('        id: ', i + 1)",
        cat("'        text: '", g.label("'text'", "i")),
        cat("'        risk: '", g.pick(["low", "medium", "high"], "'risk'", "i")),
        cat("'        verifymethod: '", g.pick(["test", "analysis", "inspection"], "'method'", "i")),
        "'    }'",
    )
    return nl(
        "'requirementDiagram'", upto(g.rnd(1, 3, "'n'"), "i", part), "'    element elem0 {'",
        "'        type: simulation'", "'    }'", "'    elem0 - satisfies -> req0'",
    )


def gitgraph(g: G) -> str:
    part = nl(
        "concat('    branch feature', i)", upto(g.rnd(1, 3, "'commits'", "i"), "j", "'    commit'"),
        "'    checkout main'", "concat('    merge feature', i)",
    )
    return nl("'gitGraph'", "'    commit'", upto(g.rnd(1, 2, "'n'"), "i", part))


def c4(g: G) -> str:
    return let(
        g.rnd(1, 2, "'n'"), "n",
        nl(
            "'C4Context'", cat("'    Person(user, \"'", g.pick(["User", "Admin", "Customer"], "'person'"), "'\")'"),
            upto("n", "i", cat("'    System(sys'", "i", "', \"'", g.label("'system'", "i"), "'\")'")),
            "'    Rel(user, sys0, \"Uses\")'",
            upto("n - 1", "i", "concat('    Rel(sys', i, ', sys', i + 1, ', \"Calls\")')"),
        ),
    )


def mindmap(g: G) -> str:
    leaf = cat("'      '", g.noun("'leaf'", "i", "j"), "i", "j")
    child = nl(cat("'    '", g.noun("'child'", "i"), "i"), upto(g.rnd(0, 2, "'leaves'", "i"), "j", leaf))
    return nl("'mindmap'", "'  Root'", upto(g.rnd(2, 4, "'n'"), "i", child))


def timeline(g: G) -> str:
    row = cat("'    '", before("gs", g.rnd(2018, 2023, "'start'")), "' : '", g.label("'row'", "i"))
    return let(
        upto(g.rnd(3, 5, "'n'"), "i", g.rnd(1, 2, "'gap'", "i")), "gs",
        nl("'timeline'", cat("'    title '", g.pick(["Company History", "Project Milestones"], "'title'")), upto("len(gs)", "i", row)),
    )


def sankey(g: G) -> str:
    row = cat("ns[i + 1]", "','", "ns[i + 2]", "','", g.rnd(5, 50, "'value'", "i"))
    return let(g.sample(g.nouns, g.rnd(3, 5, "'n'"), "'node'"), "ns", nl("'sankey-beta'", "''", upto("len(ns) - 1", "i", row)))


def xychart(g: G) -> str:
    months = g.sample(["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul"], "len(vs)", "'month'")
    return let(
        upto(g.rnd(3, 6, "'n'"), "i", g.rnd(10, 100, "'value'", "i")), "vs",
        nl(
            "'xychart-beta'", cat("'    title \"'", g.pick(["Sales", "Revenue", "Usage"], "'title'"), "'\"'"),
            cat("'    x-axis ['", f"array_to_string(list_transform({months}, lambda m: concat('\"', m, '\"')), ', ')", "']'"),
            "concat('    y-axis \"Value\" 0 --> ', list_max(vs) + 20)", "concat('    bar [', array_to_string(vs, ', '), ']')",
        ),
    )


def block(g: G) -> str:
    letters = f"array_to_string(list_slice({arr('abcdef')}, 1, {g.rnd(3, 6, chr(39)+'n'+chr(39))}), ' ')"
    return nl("'block-beta'", cat("'    columns '", g.rnd(2, 3, "'columns'")), cat("'    '", letters))


def packet(g: G) -> str:
    row = cat("'    '", before("ws", "0"), "'-'", before("ws", "0") + " + ws[i + 1] - 1", "': \"'", g.noun("'field'", "i"), "'\"'")
    return let(
        upto(g.rnd(2, 4, "'n'"), "i", g.pick([8, 16], "'width'", "i")), "ws",
        nl("'packet-beta'", cat("'    title '", g.pick(["Packet", "Header"], "'title'")), upto("len(ws)", "i", row)),
    )


def kanban(g: G) -> str:
    task = cat("'        task'", "cs[i + 1]", "j", "'['", g.label("'task'", "i", "j"), "']'")
    part = nl("concat('    ', cs[i + 1])", upto(g.rnd(1, 3, "'tasks'", "i"), "j", task))
    cols = g.sample(["Todo", "Doing", "Review", "Done"], g.rnd(2, 4, "'n'"), "'column'")
    return let(cols, "cs", nl("'kanban'", upto("len(cs)", "i", part)))


def architecture(g: G) -> str:
    row = cat(
        "'    service svc'", "i", "'('", g.pick(["server", "database", "disk"], "'icon'", "i"), "')['",
        g.label("'service'", "i"), "'] in api'",
    )
    return nl("'architecture-beta'", "'    group api(cloud)[API]'", upto(g.rnd(2, 3, "'n'"), "i", row))


def radar(g: G) -> str:
    def curve(name):
        vals = upto("len(axs)", "i", g.rnd(1, 100, "'curve'", f"'{name}'", "i"))
        return cat(f"'    curve {name}[\"{name}\"]{{'", f"array_to_string({vals}, ', ')", "'}'")

    names = "array_to_string(list_transform(axs, lambda a: concat(a[1:3], '[\"', a, '\"]')), ', ')"
    return let(
        g.sample(g.nouns, g.rnd(3, 5, "'n'"), "'axis'"), "axs",
        nl(
            "'radar-beta'", cat("'    title '", g.pick(["Comparison", "Scores"], "'title'")), cat("'    axis '", names),
            curve("A"), curve("B"), "'    max 100'", "'    min 0'",
        ),
    )


def eventmodeling(g: G) -> str:
    row = cat(
        "'    tf '", "printf('%02d', i + 1)", "' '", g.pick(["ui", "cmd", "evt"], "'kind'", "i"), "' '",
        g.cap("'noun'", "i"), g.verb("'verb'", "i"),
    )
    return nl("'eventmodeling'", upto(g.rnd(3, 5, "'n'"), "i", row))


def treemap(g: G) -> str:
    leaf = cat("'        \"'", g.label("'leaf'", "i", "j"), "'\": '", g.rnd(5, 50, "'value'", "i", "j"))
    part = nl(cat("'    \"'", g.cap("'group'", "i"), "'\"'"), upto(g.rnd(1, 3, "'leaves'", "i"), "j", leaf))
    return nl("'treemap-beta'", upto(g.rnd(2, 3, "'n'"), "i", part))


def venn(g: G) -> str:
    row = cat("'    set '", "['A','B','C'][i + 1]", "'[\"'", g.cap("'set'", "i"), "'\"]'")
    return nl("'venn-beta'", upto(g.rnd(2, 3, "'n'"), "i", row), "'    union A,B'")


def ishikawa(g: G) -> str:
    part = nl("concat('        ', bs[i + 1])", upto(g.rnd(1, 2, "'causes'", "i"), "j", cat("'            '", g.label("'cause'", "i", "j"))))
    bones = g.sample(["Process", "People", "Equipment", "Environment"], g.rnd(2, 4, "'n'"), "'category'")
    head = cat("'    '", g.pick(["Problem", "Defect", "Issue"], "'problem'"))
    return let(bones, "bs", nl("'ishikawa-beta'", head, upto("len(bs)", "i", part)))


def wardley(g: G) -> str:
    return nl("'wardley-beta'", cat("'    title '", g.pick(["Value Chain", "Map"], "'title'")))


def cynefin(g: G) -> str:
    return nl("'cynefin-beta'", cat("'    title '", g.pick(["Framework", "Decision Map"], "'title'")))


def treeview(g: G) -> str:
    part = nl(cat("'  '", g.noun("'folder'", "i"), "'/'"), cat("'    '", g.noun("'file'", "i"), "'.txt'"))
    return nl("'treeView-beta'", cat(g.noun("'root'"), "'-project/'"), upto(g.rnd(2, 4, "'n'"), "i", part))


def negative(g: G) -> str:
    line = f"array_to_string({upto(g.rnd(6, 11, chr(39)+'words'+chr(39), 'i'), 'j', g.pick(v.NEGATIVE_WORDS, chr(39)+'word'+chr(39), 'i', 'j'))}, ' ')"
    return nl(upto(g.rnd(8, 14, "'lines'"), "i", line))


GRAMMAR = {name: globals()[name] for name in v.DIAGRAM_TYPES}

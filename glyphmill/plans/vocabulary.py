"""Fixed values of the corpus: names, word lists, formats."""

from __future__ import annotations

from typing import NamedTuple

# These must be exactly so for generated text, labels and manifests
# to be readable by the tools that consume them.
DIAGRAM_TYPES = [
    "flowchart", "swimlanes", "sequence", "class_diagram", "state_diagram",
    "er_diagram", "journey", "gantt", "pie", "quadrant", "requirement",
    "gitgraph", "c4", "mindmap", "timeline", "sankey", "xychart", "block",
    "packet", "kanban", "architecture", "radar", "eventmodeling", "treemap",
    "venn", "ishikawa", "wardley", "cynefin", "treeview",
]
NEGATIVE_CLASS = "not_diagram"
VERBS = [
    "Load", "Validate", "Check", "Send", "Update", "Generate", "Notify",
    "Save", "Process", "Fetch", "Parse", "Build", "Deploy", "Review",
    "Approve", "Reject", "Retry", "Cancel", "Compute", "Archive",
]
NOUNS = [
    "data", "input", "status", "email", "database", "report", "user",
    "file", "request", "order", "payment", "config", "results",
    "error", "connection", "invoice", "token", "session", "queue",
]
THEMES = [
    "default", "base", "dark", "forest", "neutral", "neo", "neo-dark",
    "redux", "redux-dark", "redux-color", "redux-dark-color",
]
LOOKS = ["classic", "handDrawn", "neo"]
WIDTHS = [600, 800, 1000]
NEGATIVE_WORDS = (
    "the quarterly report indicates steady growth across all regions "
    "while operating costs remained flat compared to last year "
    "management expects this trend to continue into the next fiscal "
    "period pending approval from the board of directors"
).split()
SPECIAL_TOKENS = ["<pad>", "<s>", "</s>", "<unk>"]
PAD, BOS, EOS, UNK = 0, 1, 2, 3
MAX_LEN = 640
MAX_NEW_TOKENS = 500
VAL_FRACTION = 0.15
VOCAB_SIZE = 6000
FIXED_SET_SEED = 1234
# Types whose grammar yields only a handful of different texts.
TEMPLATED_TYPES = ["gitgraph", "state_diagram", "block", "cynefin", "wardley"]
# End of the fixed values.

CLASSES = sorted([NEGATIVE_CLASS, *DIAGRAM_TYPES])


class Words(NamedTuple):
    """Word lists the labels are drawn from; pass longer ones for richer labels."""

    verbs: list[str] = VERBS
    nouns: list[str] = NOUNS

"""Structure-aware chunking: sections, sentence windows, character budgets, ideas.

The line scan of one text is sequential, so it runs in an Arrow batch function; each text is on its
own and nothing is shuffled. A null or empty text yields its title chunk only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET_WORDS, TAIL_WORDS, BUDGET = 80, 10, 480
IDEA_LEAST, IDEA_MOST = 200, 500
_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")


def fence(line: str) -> str:
    """The marks that open a code fence: three or more alike after at most three spaces; no back tick may follow back ticks."""
    bare = line.lstrip(" ")
    if len(line) - len(bare) > 3 or bare[:1] not in ("`", "~"):
        return ""
    marks = bare[: len(bare) - len(bare.lstrip(bare[0]))]
    rest = bare[len(marks) :]
    return "" if len(marks) < 3 or (bare[0] == "`" and "`" in rest) else marks


def closes(line: str, marks: str) -> bool:
    """Whether a line closes the fence that ``marks`` opened: as many of the same, and nothing else."""
    here = fence(line)
    return here[:1] == marks[0] and len(here) >= len(marks) and line.strip() == here


def sections(text: str) -> list[tuple[list[str], str]]:
    """(breadcrumb of headings, body) in order; fences and front matter hold no headings."""
    lines = text.split("\n")
    if lines and lines[0].strip() == "---":
        end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
        lines = lines[end + 1 :] if end else lines
    out: list[tuple[list[str], list[str]]] = [([], [])]
    trail: list[tuple[int, str]] = []
    fenced = ""
    for line in lines:
        if not fenced:
            fenced = fence(line)
        elif closes(line, fenced):
            fenced = ""
        found = None if fenced else _HEADING.match(line)
        if found:
            level = len(found[1])
            trail = [t for t in trail if t[0] < level] + [(level, re.sub(r"[*_`]|\[\[|\]\]", "", found[2]))]
            out.append(([t[1] for t in trail], []))
        else:
            out[-1][1].append(line)
    return [(crumbs, "\n".join(body).strip()) for crumbs, body in out if crumbs or "\n".join(body).strip()]


def split_sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)) if s]


def windows(sentences: list[str], target: int = TARGET_WORDS, tail: int = TAIL_WORDS) -> list[str]:
    """Windows of about ``target`` words that overlap by a sentence; a short tail joins the one before."""
    out: list[list[str]] = []
    now: list[str] = []
    fresh = 0  # sentences that no window holds yet
    for s in sentences:
        now.append(s)
        fresh += 1
        if sum(len(x.split()) for x in now) >= target:
            out.append(now)
            now, fresh = [s], 0
    if fresh:
        rest = now[len(now) - fresh :]
        if out and sum(len(x.split()) for x in rest) < tail:
            out[-1] = out[-1] + rest
        else:
            out.append(now)
    return [" ".join(w) for w in out]


def to_budget(text: str, budget: int = BUDGET) -> list[str]:
    """Pieces of at most ``budget`` characters: whole sentences, an oversize one cut at the last space past half."""
    out: list[str] = []
    now = ""
    for s in split_sentences(text):
        while len(s) > budget:
            if now:
                out.append(now)
                now = ""
            cut = s.rfind(" ", budget // 2, budget + 1)
            cut = cut if cut > 0 else budget
            out.append(s[:cut].strip())
            s = s[cut:].strip()
        if now and len(now) + 1 + len(s) > budget:
            out.append(now)
            now = s
        else:
            now = f"{now} {s}".strip()
    return out + ([now] if now else [])


def _content(text: str) -> set[str]:
    return {w for w in re.findall(r"\w+", text.lower()) if len(w) > 3}


def ideas(chunks: list[tuple[int, str]], least: int = IDEA_LEAST, most: int = IDEA_MOST) -> list[int]:
    """Idea number of each (section, text): new at a change of section or a valley of lexical cohesion.

    A valley is a local minimum, below the mean, of the word overlap of adjacent passages. An idea has
    ``least`` words before a boundary counts and is cut at ``most``; a text under ``least`` is one idea.
    """
    sizes = [len(t.split()) for _, t in chunks]
    if sum(sizes) < least:
        return [1] * len(chunks)
    words = [_content(t) for _, t in chunks]
    near = [len(a & b) / max(1, len(a | b)) for a, b in zip(words, words[1:], strict=False)]
    mean = sum(near) / max(1, len(near))
    out, idea, size = [], 1, 0
    for i in range(len(chunks)):
        if i:
            x = near[i - 1]
            valley = x < mean and x <= (near[i - 2] if i > 1 else 1) and x <= (near[i] if i < len(near) else 1)
            if size >= least and (chunks[i][0] != chunks[i - 1][0] or valley) or size + sizes[i] > most and size:
                idea, size = idea + 1, 0
        out.append(idea)
        size += sizes[i]
    return out


def chunk_text(title: str, text: str, most: int = 48, heading_context: bool = True) -> list[tuple[int, int, str]]:
    """(chunk, idea, text): the title, then passages in order, at most ``most`` in all."""
    body: list[tuple[int, str]] = []
    for k, (crumbs, part) in enumerate(sections(text)):
        first = True
        for block in re.split(r"\n\s*\n", part):
            for w in windows(split_sentences(" ".join(block.split()))):
                for piece in to_budget(w):
                    lead = " > ".join([title, *crumbs]) + ": " if heading_context and first and crumbs else ""
                    body.append((k, lead + piece))
                    first = False
    body = body[: most - 1]
    return [(0, 0, title), *((i + 1, idea, t) for i, ((_, t), idea) in enumerate(zip(body, ideas(body), strict=True)))]


def chunk(notes: DataFrame, id_col: str = "note_id", title: str = "title", text: str = "body", most: int = 48) -> DataFrame:
    """(id, chunk_ix, is_title, idea_id, text) of every note."""
    kind = dict(notes.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, ix, idea, out = [], [], [], []
            for r, (t, x) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for a, b, c in chunk_text(t or "", x or "", most):
                    who.append(r)
                    ix.append(a)
                    idea.append(b)
                    out.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array(ix, pa.int32()), pa.array([i == 0 for i in ix], pa.bool_()), pa.array(idea, pa.int32()), pa.array(out, pa.string())], names=[id_col, "chunk_ix", "is_title", "idea_id", "text"])

    return notes.select(id_col, F.col(title), F.col(text)).mapInArrow(run, f"`{id_col}` {kind}, chunk_ix int, is_title boolean, idea_id int, text string")


def embed_input(title: str, tags: str | None, aliases: str | None, text: str) -> "F.Column":
    """What is embedded for a passage: title, tags and aliases before the text."""
    parts = [F.col(title), *(F.array_join(c, " ") for c in (tags, aliases) if c), F.col(text)]
    return F.concat_ws("\n", *parts)

"""Uses clauses of source files, with the conditions that guard them.

Files are independent: each is read by itself, row-parallel; only include files too large to be held
by every task are joined with those that name them.
"""

from __future__ import annotations

import operator
import posixpath
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitgraph.operators.includes import reached_includes, search_key
from unitgraph.operators.ranks import small

LEX = re.compile(
    r"(?P<directive>\{\$[^}]*\}?|\(\*\$.*?(?:\*\)|\Z))|(?P<comment>//[^\r\n]*|\{[^}]*\}?|\(\*.*?(?:\*\)|\Z))|(?P<text>'(?:[^'\r\n]|'')*'?)"
    r"|(?P<name>&?[^\W\d]\w*(?:\.[^\W\d]\w*)*)|(?P<number>[$#\d][\w.]*)|(?P<other>[,;])",
    re.DOTALL,
)
COMPARE = {"=": lambda a, b: abs(a - b) < 1e-9, "<>": lambda a, b: abs(a - b) >= 1e-9, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
#: A directive's name.
WORD = re.compile(r"(?:[^\W\d_])*")
#: Control characters and the space.
BLANK = "".join(map(chr, range(33)))
TERM = re.compile(r"\s*(<>|<=|>=|[()=<>]|[^\W\d][\w.]*|\d+(?:\.\d+)?|\S)")


def _and(a: bool | None, b: bool | None) -> bool | None:
    return False if a is False or b is False else None if a is None or b is None else True


def _not(a: bool | None) -> bool | None:
    return None if a is None else not a


def _or(a: bool | None, b: bool | None) -> bool | None:
    return _not(_and(_not(a), _not(b)))


def evaluate(text: str, defines: set[str], numerics: Mapping[str, float]) -> bool | None:
    """True, false, or None where it can not be told. Or binds least, then And, Not, comparison."""
    terms = [t for t in TERM.findall(text) if t.strip()] + [""]
    at = 0

    def take(*words: str) -> bool:
        nonlocal at
        if terms[at].upper() in words:
            at += 1
            return True
        return False

    def chain(word: str, inner: Callable, join: Callable) -> object:
        out = inner()
        while take(word):
            out = join(_truth(out), _truth(inner()))
        return out

    def negated() -> object:
        return _not(_truth(negated())) if take("NOT") else compared()

    def compared() -> object:
        left = primary()
        if terms[at] in COMPARE:
            sign = terms[at]
            take(sign)
            right = primary()
            numbers = all(isinstance(x, float) for x in (left, right))
            return COMPARE[sign](left, right) if numbers else None
        return left

    def primary() -> object:
        nonlocal at
        word = terms[at].upper()
        at = min(at + 1, len(terms) - 1)
        if word == "(":
            out = chain("OR", lambda: chain("AND", negated, _and), _or)
            if not take(")"):
                raise SyntaxError(text)
            return out
        if word in ("DEFINED", "DECLARED") and take("("):
            name = terms[at].upper()
            at = min(at + 1, len(terms) - 1)
            if not take(")"):
                raise SyntaxError(text)
            return name in defines if word == "DEFINED" else None
        if word in ("TRUE", "FALSE"):
            return word == "TRUE"
        if word and (word[0].isalpha() or word[0] == "_"):
            return numerics.get(word)
        if word[:1].isdigit():
            return float(word)
        raise SyntaxError(text)

    try:
        out = _truth(chain("OR", lambda: chain("AND", negated, _and), _or))
        return out if terms[at] == "" else None
    except SyntaxError:
        return None


def _truth(x: object) -> bool | None:
    return x if isinstance(x, bool) else None


@dataclass
class Frame:
    """One open conditional: whether its branch is taken, and how it reads."""

    now: bool | None
    prior: bool | None
    label: str
    labels: list[str]
    dead: bool
    warning: tuple[str, int, str] | None = None


@dataclass
class Scanner:
    """Reads one file for one target."""

    defines: set[str]
    numerics: Mapping[str, float]
    include: Callable[[str, str], tuple[str, str] | None]
    entries: list[dict] = field(default_factory=list)
    warnings: list[tuple[str, int, str]] = field(default_factory=list)
    included: list[str] = field(default_factory=list)
    frames: list[Frame] = field(default_factory=list)
    name: str = ""
    is_program: bool = False
    header: str = ""
    section: str = "interface"
    in_uses: bool = False
    after_in: bool = False
    entry: dict | None = None

    def scan(self, file: str, text: str) -> None:
        self._run(file, text, (file.lower(),))
        self._close()
        if self.frames:
            self.warnings.append((file, 0, f"{len(self.frames)} conditional directive(s) were never closed"))

    def _active(self) -> bool:
        return all(f.now is not False for f in self.frames)

    def _close(self) -> None:
        if self.entry is not None:
            self.entries.append(self.entry)
            self.entry = None

    def _run(self, file: str, text: str, chain: tuple[str, ...]) -> None:
        line, last = 1, 0
        for m in LEX.finditer(text):
            line += len(re.findall(r"\r\n|\n|\r", text[last : m.start()]))
            last = m.start()
            kind, token = m.lastgroup, m[0]
            if kind == "directive":
                body = token[2:].removesuffix("}") if token.startswith("{$") else token[3:].removesuffix("*)")
                self._directive(file, line, body, chain)
            elif kind in ("name", "text", "other") and self._active():
                self._token(file, line, kind, token)

    def _token(self, file: str, line: int, kind: str, token: str) -> None:
        low = token.lower()
        if kind == "name":
            low = low.removeprefix("&")
            if self.header == "":
                if low in ("unit", "program", "library", "package"):
                    self.header = low
                return
            if not self.name:
                self.name, self.is_program = token.removeprefix("&"), self.header != "unit"
                self.section = "program" if self.is_program else "interface"
                return
            if self.in_uses:
                if low == "in" and self.entry is not None and not token.startswith("&"):
                    self.after_in = True
                    return
                self._close()
                self._start(file, line, token.removeprefix("&"))
            elif low == "uses":
                self.in_uses = True
            elif low == "implementation" and not self.is_program:
                self.section = "implementation"
        elif kind == "text" and self.in_uses and self.after_in and self.entry is not None:
            self.entry["in_path"] = token.strip("'").replace("''", "'")
            self.after_in = False
        elif kind == "other" and self.in_uses:
            self._close()
            self.after_in = False
            if token == ";":
                self.in_uses = False

    def _start(self, file: str, line: int, name: str) -> None:
        certainty = "unconditional" if not self.frames else "unevaluated" if any(f.now is None for f in self.frames) else "conditional"
        self.entry = {"unit_name": name, "section": self.section, "certainty": certainty, "cond": " and ".join(f.label for f in self.frames), "file": file, "line": line, "in_path": ""}
        for f in self.frames:
            if f.warning is not None:
                self.warnings.append(f.warning)
                f.warning = None

    def _directive(self, file: str, line: int, body: str, chain: tuple[str, ...]) -> None:
        # The name is the letters right after the sign; all that follows, whatever parts it, is the parameter.
        word = WORD.match(body)[0]
        word, rest = word.upper(), body[len(word) :].strip(BLANK)
        if word in ("IFDEF", "IFNDEF", "IFOPT", "IF"):
            dead = not self._active()
            warning = None
            if word == "IF":
                value, label = evaluate(rest, self.defines, self.numerics), rest
                warning = self._cannot(file, line, word, rest) if value is None else None
            elif word == "IFOPT":
                value, label = None, rest
            else:
                hit = rest.upper() in self.defines
                value, label = (hit, rest) if word == "IFDEF" else (not hit, f"not {rest}")
            self.frames.append(Frame(False if dead else value, True if dead else value, label, [label], dead, warning))
        elif word in ("ELSE", "ELSEIF"):
            if not self.frames:
                self.warnings.append((file, line, f"{{${word}}} without a matching {{$IF}}"))
                return
            f = self.frames[-1]
            # What could not be told stays to be reported, whichever branch an entry is in.
            if word == "ELSE":
                f.now, f.label = _not(f.prior), f"not ({' or '.join(f.labels)})"
            else:
                value = evaluate(rest, self.defines, self.numerics)
                if value is None and f.prior is not True:
                    f.warning = self._cannot(file, line, word, rest)
                f.now, f.prior = _and(_not(f.prior), value), _or(f.prior, value)
                f.label = rest
                f.labels.append(rest)
            if f.dead:
                f.now = False
        elif word in ("ENDIF", "IFEND"):
            if self.frames:
                self.frames.pop()
            else:
                self.warnings.append((file, line, f"{{${word}}} without a matching {{$IF}}"))
        elif self._active():
            if word == "DEFINE" and rest:
                self.defines.add(rest.upper())
            elif word == "UNDEF" and rest:
                self.defines.discard(rest.upper())
            elif word in ("I", "INCLUDE") and rest and rest[0] not in "+-" and not (len(rest) > 1 and rest[0] == rest[-1] == "%"):
                self._include(file, line, rest[1:-1] if len(rest) > 1 and rest[0] == rest[-1] == "'" else rest, chain)

    @staticmethod
    def _cannot(file: str, line: int, word: str, rest: str) -> tuple[str, int, str]:
        return file, line, f"cannot evaluate {{${word} {rest}}}, taking every branch"

    def _include(self, file: str, line: int, name: str, chain: tuple[str, ...]) -> None:
        found = self.include(file, name)
        if found is None:
            self.warnings.append((file, line, f'include file not found: "{name}"'))
        elif found[0].lower() in chain:
            self.warnings.append((file, line, f'include cycle detected at "{name}"'))
        else:
            self.included.append(found[0])
            self._run(found[0], found[1], (*chain, found[0].lower()))


UNIT = "struct<unit_name:string,section:string,certainty:string,cond:string,file:string,line:int,in_path:string>"
SCANNED = f"graph_id string, path string, header string, is_program boolean, entries array<{UNIT}>, warnings array<struct<file:string,line:int,message:string>>, included array<string>"


def _finder(includes: Mapping[str, tuple[str, str]], folders: Sequence[str] = ()) -> Callable[[str, str], tuple[str, str] | None]:
    """Looks an include file up: beside the file that names it, then in the search folders in order.

    ``includes``: path in lower case, with forward slashes, to (path, text). A name without an extension
    is tried with ``.inc`` first.
    """
    where = [f.replace("\\", "/").lower().rstrip("/") for f in folders]

    def find(parent: str, name: str) -> tuple[str, str] | None:
        name = name.strip().replace("\\", "/").lower()
        beside = parent.replace("\\", "/").lower().rpartition("/")[0]
        for n in [name] if "." in name.rpartition("/")[2] else [f"{name}.inc", name]:
            for folder in ("", beside, *where) if n.startswith("/") else (beside, *where):
                found = includes.get(posixpath.normpath(f"{folder}/{n}" if folder else n))
                if found is not None:
                    return found
        return None

    return find


#: Characters of include files that every task may hold.
MOST_INCLUDED = 64_000_000


def _by_path(files: Iterable[tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """Include files by the path they are compared by; of several, the least path and text."""
    out: dict[str, tuple[str, str]] = {}
    for path, text in sorted(files):
        out.setdefault(posixpath.normpath(path.replace("\\", "/").lower()), (path, text))
    return out


def _held(includes: DataFrame, most: int) -> dict[str, dict[str, tuple[str, str]]] | None:
    """The include files of each graph, or None if they have more than ``most`` characters."""
    size = includes.agg(F.sum(F.length(F.coalesce("content", F.lit(""))) + F.length("path"))).first()[0] or 0
    if size > most:
        return None
    files: dict[str, list[tuple[str, str]]] = {}
    for r in includes.where("path is not null").select("graph_id", "path", "content").collect():
        files.setdefault(r["graph_id"], []).append((r["path"], r["content"] or ""))
    return {g: _by_path(f) for g, f in files.items()}


#: Entries, warnings and included files that a worker gathers before it hands them on.
MOST_GATHERED = 10_000


def scan_batches(batches: Iterator[pd.DataFrame], held: dict[str, dict[str, tuple[str, str]]] | None, most: int = MOST_GATHERED) -> Iterator[pd.DataFrame]:
    """Files scanned, handed on whenever ``most`` values have come together: a batch of files has far more than a worker can hold."""
    columns = ["graph_id", "path", "header", "is_program", "entries", "warnings", "included"]
    out, n = [], 0
    for b in batches:
        for r in b.itertuples(index=False):
            texts = held.get(r.graph_id, {}) if held is not None else _by_path(dict(r.own or {}).items())
            find = _finder(texts, r.folders if r.folders is not None else ())
            s = Scanner(set(r.defines), {k.upper(): float(v) for k, v in dict(r.numerics or {}).items()}, find)
            s.scan(r.path, r.content or "")
            out.append((r.graph_id, r.path, s.name, s.is_program, s.entries, [{"file": f, "line": n, "message": m} for f, n, m in s.warnings], s.included))
            n += 1 + len(s.entries) + len(s.warnings) + len(s.included)
            if n >= most:
                yield pd.DataFrame(out, columns=columns)
                out, n = [], 0
    if out:
        yield pd.DataFrame(out, columns=columns)


def scan_corpus(corpus: DataFrame, targets: DataFrame, includes: DataFrame | None = None, most_included: int = MOST_INCLUDED) -> DataFrame:
    """Each file scanned for each target of its graph: header, entries, warnings, included files.

    ``corpus``: (graph_id, path, content); ``targets``: (graph_id, defines, numerics) and, where includes
    are searched beyond the folder of the file that names them, ``folders`` in order. ``includes``:
    (graph_id, path, content), looked up within their graph only. Up to ``most_included`` characters of them
    are held by every task; if there are more, each file is joined with those that it can reach. Both give
    the same rows. A directive in one file never reaches another. Null contents are empty files.
    """
    folders = F.col("folders") if "folders" in targets.columns else F.array().cast("array<string>")
    wanted = targets.select("graph_id", "defines", "numerics", folders.alias("folders"))
    rows = corpus.join(small(wanted, wanted.count()), "graph_id").select("graph_id", "path", "content", "defines", "numerics", "folders")
    held = {} if includes is None else _held(includes, most_included)
    if held is None:
        rows = rows.withColumn("search", search_key()).join(reached_includes(corpus, includes, wanted), ["search", "path"], "left")
    else:
        rows = rows.withColumn("own", F.lit(None).cast("map<string,string>"))
    rows = rows.select("graph_id", "path", "content", "defines", "numerics", "folders", "own")

    return rows.mapInPandas(partial(scan_batches, held=held), SCANNED)


def uses_entries(scanned: DataFrame) -> DataFrame:
    return scanned.select("graph_id", "path", "header", "is_program", F.posexplode("entries").alias("entry_pos", "e")).select("graph_id", "path", "header", "is_program", "entry_pos", "e.*")


def scan_warnings(scanned: DataFrame) -> DataFrame:
    return scanned.select("graph_id", "path", F.posexplode("warnings").alias("seq", "w")).select("graph_id", "path", "seq", "w.*")

"""Scripts of commands: variables, loops, conditions, includes, and references to variables, the environment and JSON values."""

from __future__ import annotations

import json
import os
import re
import shlex
from collections.abc import Callable
from pathlib import Path


class ScriptError(RuntimeError):
    pass


class Script:
    """Runs statements; anything that is none is a command given to `execute`, which returns an exit code.

    set NAME = value, default NAME = value, echo, config FILE|none, options ...|none, include FILE, foreach NAME in VALUES ... end,
    if exists|missing PATH ... end, exit. A leading dash lets a command fail. References: ${name}, ${env:NAME}, ${json:FILE:path.to.value}.
    """

    def __init__(self, execute: Callable[[list[str]], int], variables: dict[str, str] | None = None, *, keep_going: bool = False, dry_run: bool = False):
        self.execute, self.vars, self.keep_going, self.dry_run = execute, dict(variables or {}), keep_going, dry_run
        self.config: str | None = None
        self.options: list[str] = []
        self.failures, self.done, self.echoed = 0, False, []

    def run(self, path: str) -> int:
        full, before = Path(path).resolve(), os.getcwd()
        if not full.exists():
            raise ScriptError(f"{path} does not exist")
        self.vars["SCRIPT_DIR"] = str(full.parent)
        os.chdir(full.parent)
        try:
            self._block(self._lines(full))
        finally:
            os.chdir(before)
        return int(self.failures > 0)

    @staticmethod
    def _lines(path: Path) -> list[tuple[str, int, str]]:
        joined = re.sub(r"\\[ \t]*\n", lambda m: " \0", path.read_text(encoding="utf-8"))
        out, number = [], 1
        for line in joined.split("\n"):
            text = line.replace("\0", "").strip()
            if text and not text.startswith("#"):
                out.append((path.name, number, text))
            number += 1 + line.count("\0")
        return out

    def _block(self, lines: list[tuple[str, int, str]]) -> None:
        i = 0
        while i < len(lines) and not self.done:
            word = lines[i][2].split(None, 1)[0]
            if word in ("foreach", "if"):
                end = self._end(lines, i)
                body, text = lines[i + 1 : end], lines[i][2]
                if word == "foreach":
                    m = re.fullmatch(r"foreach\s+(\w+)\s+in\s+(.*)", text)
                    if not m:
                        self._fail(lines[i], "foreach NAME in VALUES")
                    for v in shlex.split(self.expand(m[2], lines[i])):
                        self.vars[m[1]] = v
                        self._block(body)
                        if self.done:
                            return
                else:
                    t = shlex.split(self.expand(text, lines[i]))
                    if len(t) != 3 or t[1] not in ("exists", "missing"):
                        self._fail(lines[i], "if exists PATH, or if missing PATH")
                    if os.path.exists(t[2]) == (t[1] == "exists"):
                        self._block(body)
                i = end
            elif word == "end":
                self._fail(lines[i], "end without foreach or if")
            else:
                self._statement(lines[i], word)
            i += 1

    def _end(self, lines, start: int) -> int:
        depth = 0
        for i in range(start, len(lines)):
            w = lines[i][2].split(None, 1)[0]
            depth += (w in ("foreach", "if")) - (w == "end")
            if not depth:
                return i
        self._fail(lines[start], "no matching end")

    def _statement(self, line: tuple[str, int, str], word: str) -> None:
        rest = line[2][len(word) :].strip()
        if word in ("set", "default"):
            name, eq, value = rest.partition("=")
            if not eq or not name.strip():
                self._fail(line, f"{word} NAME = value")
            if word == "set" or name.strip() not in self.vars:
                value = self.expand(value.strip(), line)
                self.vars[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value
        elif word == "echo":
            self.echoed.append(self.expand(rest, line))
            print(self.echoed[-1])
        elif word == "config":
            v = self.expand(rest, line).strip('"')
            self.config = None if v.lower() == "none" else os.path.abspath(v)
        elif word == "options":
            v = self.expand(rest, line)
            self.options = [] if v.lower() == "none" else shlex.split(v)
        elif word == "include":
            f = Path(self.expand(rest, line).strip('"')).resolve()
            if not f.exists():
                self._fail(line, f"{f} does not exist")
            self._block(self._lines(f))
        elif word == "exit":
            self.done = True
        else:
            tolerant = line[2].startswith("-") and not line[2].startswith("--")
            t = shlex.split(self.expand(line[2][1:] if tolerant else line[2], line))
            if not t:
                return
            if t[0] == "run":
                self._fail(line, "a script is run from a script by include")
            args = [t[0], *(["--config", self.config] if self.config and "--config" not in t else []), *self.options, *t[1:]]
            if self.dry_run:
                print("> " + shlex.join(args))
                return
            if self.execute(args):
                self.failures += 1
                if not (tolerant or self.keep_going):
                    self._fail(line, f"{t[0]} failed")

    def expand(self, text: str, line: tuple[str, int, str] = ("", 0, "")) -> str:
        for _ in range(50):
            m = re.search(r"\$\{([^${}]*)\}", text)
            if not m:
                return text
            text = text[: m.start()] + self._value(m[1], line) + text[m.end() :]
        self._fail(line, "references go in a circle")

    def _value(self, ref: str, line) -> str:
        if ref.startswith("env:"):
            return os.environ.get(ref[4:], "")
        if ref.startswith("json:"):
            f, _, path = ref[5:].rpartition(":")
            try:
                v = json.loads(Path(f).read_text(encoding="utf-8"))
                for p in path.split("."):
                    v = v[int(p)] if isinstance(v, list) else v[p]
            except (OSError, KeyError, IndexError, ValueError) as e:
                self._fail(line, f"${{{ref}}}: {e!r}")
            return v if isinstance(v, str) else json.dumps(v)
        if ref not in self.vars:
            self._fail(line, f"{ref} is not set")
        return self.vars[ref]

    @staticmethod
    def _fail(line, text: str):
        raise ScriptError(f"{line[0]}, line {line[1]}: {text}")

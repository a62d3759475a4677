"""A plain model of the tracker: one session after the other, lists and loops, no Spark and nothing of the package but its numbers.

It is written from the described behaviour, so that the set-based plan, the batch fold and the stream have something
to be compared with.
"""

import re
from difflib import SequenceMatcher

from strandline import config as C

WORD = "a-zà-ÿ"
GARBAGE = [
    re.compile(r"^[.\s,،؟!]+$"), re.compile("[一-鿿]"), re.compile("[぀-ヿ]"), re.compile("[가-힯]"),
    re.compile("subscribe|like|comment|video", re.I), re.compile("thank you for watching", re.I), re.compile("ॐ"),
    re.compile(r"^(.{1,10})\1{2,}"), re.compile("^(music|tabla|harmonium|dhol)", re.I), re.compile(r"^[\W]+$"),
]


def clean(text, state):
    """What is left of a window's text after garbage, repeated words and the overlap with the last one."""
    text = text.strip()
    good = sum(bool(re.match("[਀-੿ऀ-ॿ؀-ۿA-z]", c)) for c in text)
    if len(text) < 2 or good < 2 or any(g.search(text) for g in GARBAGE):
        return ""
    words = text.split()
    text = " ".join(w for i, w in enumerate(words) if i == 0 or w != words[i - 1])
    last = state["text"]
    if last and text.startswith(last[:20]):
        for n in range(min(len(last), len(text) // 2), 0, -1):
            if text.startswith(last[-n:]):
                text = text[n:].strip()
                break
    if text == last:
        state["same"] += 1
        if state["same"] >= 3:
            return ""
    else:
        state["same"] = 0
    state["text"] = text
    return text


def letters(text):
    found = (re.search(f"[{WORD}]", w) for w in text.lower().split())
    return "".join(m[0] for m in found if m)


def fold(text):
    return " ".join(re.findall(f"[{WORD}]+", text.lower()))


def phrases(text, start):
    w = [x for x in fold(text).split() if len(x) >= 2]
    out = []
    if len(w) >= 2:
        out.append(w[: 6 if start else 10])
    if len(w) >= 4:
        out += [w[:4], w[-4:]]
    if len(w) >= 8 and not start:
        out.append(w[len(w) // 2 - 2 : len(w) // 2 + 2])
    return list(dict.fromkeys(" ".join(p) for p in out))


def overlap(a, b):
    return len({x for x in fold(a).split() if len(x) >= 2} & {x for x in fold(b).split() if len(x) >= 2})


class Corpus:
    def __init__(self, lines):
        """(work, line, source, text, key) in order."""
        self.lines = sorted(lines)
        self.keys = {}
        for work, _, _, _, key in self.lines:
            self.keys.setdefault(work, []).append(key)
        self.folded = [f" {fold(x[3])} " for x in self.lines]

    def _where(self, test, limit):
        out = []
        for i, x in enumerate(self.lines):
            if test(i, x):
                out.append(x)
                if len(out) == limit:
                    break
        return out

    def search(self, key, text, start):
        if start:
            key = key[:8]
        found = {}

        def add(hits, tag):
            for x in hits:
                found.setdefault(x[0], [x, set()])[1].add(tag)

        if len(key) >= 3:
            add(self._where(lambda i, x: x[4].startswith(key), 10), "type0")
            if len(found) < (1 if start else 3):
                add(self._where(lambda i, x: key in x[4], 10), "type1")
            if len(found) < 2 and len(key) > 4:
                for sub in (key[:4], key[-4:]):
                    add(self._where(lambda i, x, sub=sub: x[4].startswith(sub), 5), "type0_sub")
        if text.strip():
            for p in phrases(text, start):
                add(self._where(lambda i, x, p=p: f" {p} " in self.folded[i], 8), "type2")
        return list(found.values())


def similar(a, b):
    m = SequenceMatcher(None, a, b)
    return m.ratio(), m.find_longest_match(0, len(a), 0, len(b)).size / max(len(a), 1)


class Tracker:
    def __init__(self, corpus):
        self.corpus, self.out = corpus, []
        self.state, self.work, self.line, self.keys = "searching", None, 0, []
        self.history, self.evidence = [], {}
        self.pending, self.wins, self.misses, self.rival, self.rival_wins, self.weak = None, 0, 0, None, 0, 0
        self.silent, self.in_break, self.boost, self.armed, self.armed_left = 0, False, 0, None, 0
        self.previous, self.paused, self.p, self.rate = "", False, C.BALANCED, 0.0
        self.heard = {"text": "", "same": 0}

    def emit(self, kind, *values):
        self.out.append((self.now, kind, *values))

    def score(self, key, text, start):
        out = []
        for (work, _, source, line, line_key), tags in self.corpus.search(key, text, start):
            value = 0.0
            if key and line_key:
                ratio, run = similar(key, line_key)
                value = 0.4 * ratio + 0.3 * run + 0.2 * (1.0 if work == self.work else 0.5) + 0.1 * (1.0 if source == "G" else 0.5)
            n = overlap(text, line)
            if "type2" in tags:
                value += 0.10 if n >= 2 else 0.05 if n == 1 else 0
            value = min(1.0, max(0.0, value))
            out.append({"work": work, "score": round(value, 3), "overlap": n, "auto": value >= self.p.auto})
        return sorted(out, key=lambda c: -c["score"])

    def strength(self, h):
        return min(1.0, h["total"] + min(0.2, 0.03 * h["n"]))

    def observe(self, found):
        for h in self.evidence.values():
            h["total"] *= 0.85
        for c in found[:5]:
            if c["work"] > 0:
                h = self.evidence.setdefault(c["work"], {"total": 0.0, "n": 0})
                h["total"] += c["score"]
                h["n"] += 1
                h["seen"] = self.now
        live = [(w, h) for w, h in self.evidence.items() if self.now - h["seen"] <= 2]
        live.sort(key=lambda x: -self.strength(x[1]))
        self.evidence = dict(live[:5])

    def best(self):
        if not self.evidence:
            return None
        w, h = max(self.evidence.items(), key=lambda x: self.strength(x[1]))
        return w, round(self.strength(h), 3), h["n"]

    def lock(self, work, score):
        if self.work is not None:
            self.history.append((self.work, self.line))
        self.work, self.line, self.keys, self.state = work, 0, self.corpus.keys.get(work, []), "locked"
        self.rival, self.rival_wins, self.pending, self.wins = None, 0, None, 0
        self.armed, self.armed_left = None, 0
        self.emit("display", work)
        self.emit("locked", work, score)

    def release(self):
        if self.work is not None:
            self.history.append((self.work, self.line))
        self.work, self.keys, self.state = None, [], "searching"
        self.rival, self.rival_wins, self.pending, self.wins = None, 0, None, 0

    def miss(self):
        if self.state == "candidate_lock":
            self.misses += 1
            if self.misses >= self.p.miss_windows:
                self.misses, self.pending, self.wins, self.state = 0, None, 0, "searching"

    def search(self, key, text):
        found = self.score(key, text, self.boost > 0)[:5]
        self.observe(found)
        self.emit("candidates", found[0]["work"] if found else None, found[0]["score"] if found else None)
        best = self.best()
        top = next((c for c in found if best and c["work"] == best[0]), None)
        told, n = (best[1], best[2]) if top else (found[0]["score"] if found else 0, 1)
        top = top or (found[0] if found else None)
        p = self.p
        fits = top is not None and top["score"] >= p.min_raw and (
            (top["score"] >= p.auto and top["overlap"] >= p.overlap_auto)
            or (told >= p.auto and n >= p.lock_windows and top["overlap"] >= p.overlap_evidence)
        )
        if not fits:
            self.armed, self.armed_left = None, 0
            self.miss()
            return
        shown = round(max(top["score"], told), 3)
        self.armed, self.armed_left, self.misses = (top["work"], shown), 2, 0
        if not (top["score"] >= p.instant and top["overlap"] >= p.overlap_instant):
            self.wins = self.wins + 1 if self.pending == top["work"] else 1
            self.pending, self.state = top["work"], "candidate_lock"
            if self.wins < p.lock_windows:
                self.emit("pending", top["work"], shown)
                return
        self.lock(top["work"], shown)
        self.boost = 0

    def line_value(self, key, i):
        if not key or not self.keys[i]:
            raw = 0.0
        else:
            ratio, run = similar(key, self.keys[i])
            raw = 0.5 * ratio + 0.5 * run
        if raw >= 0.88:
            return raw
        d = i - self.line
        bias = -0.04 * min(-d, 3) if d < 0 else {0: 0.12, 1: 0.16, 2: 0.10, 3: -0.06}.get(d, -0.08)
        return min(1.0, max(0.0, raw + bias))

    def follow(self, key, text):
        if not self.keys:
            self.state = "searching"
            return
        every = range(len(self.keys))
        self.line = min(max(self.line, 0), len(self.keys) - 1)
        plain = [self.line_value(key, i) for i in every]
        values, name = plain, "current"
        if self.previous:
            forms = [("prev_current", self.previous + key), ("current_prev", key + self.previous)]
            forms = [(n, q) for i, (n, q) in enumerate(forms) if q != key and q not in [x for _, x in forms[:i]]]
            more, names = list(plain), ["current"] * len(plain)
            for n, q in forms:
                for i in every:
                    v = self.line_value(q, i)
                    if v > more[i]:
                        more[i], names[i] = v, n
            if max(more) > max(plain):
                values, name = more, names[more.index(max(more))]
        best = max(values)
        at = values.index(best) if best > 0 else 0
        near = [i for i in every if abs(i - self.line) <= 2]
        local = sorted(near, key=lambda i: (-values[i], i != self.line, i))[0]
        self.emit("aligned", self.work, at, round(best, 3), name)
        good = best >= self.p.suggest
        if good or (values[local] >= self.p.local_follow and local != self.line):
            self.weak = 0
            to = at if good else local
            for _ in range(abs(to - self.line)):
                self.emit("navigate", self.work, "next" if to > self.line else "prev")
            self.line, self.state, self.rival, self.rival_wins = to, "locked", None, 0
        else:
            self.state = "unstable_lock"
            self.weak = self.weak + 1 if best < 0.35 else max(0, self.weak - 1)
            if self.weak >= self.p.weak_windows:
                old = self.work
                self.release()
                self.weak = 0
                self.emit("switched", None, old, "weak_locked_recovery")
                return
        self.scan(key, text, best)

    def scan(self, key, text, line_best):
        found = self.score(key, text, False)
        self.observe(found)
        self.emit("candidates", found[0]["work"] if found else None, found[0]["score"] if found else None)
        if not found:
            return
        best, top, score = self.best(), found[0], found[0]["score"]
        if best and best[0] != self.work and best[2] >= 2:
            other = next((c for c in found if c["work"] == best[0]), None)
            if other:
                top, score = other, round(max(other["score"], best[1]), 3)
        if top["work"] == self.work:
            return
        mine = next((c["score"] for c in found if c["work"] == self.work), 0.0)
        old, p = self.work, self.p
        if top["score"] >= p.switch_score and top["overlap"] >= p.overlap_switch and top["score"] - mine >= p.switch_margin:
            # The switch is told before the new work is shown.
            self.emit("switched", top["work"], old, "instant_challenger")
            self.lock(top["work"], score)
            self.weak = 0
            return
        recovering = self.weak >= max(1, p.weak_windows - 1) and line_best < 0.35
        if not top["auto"] and not (recovering and score >= p.recovery_score):
            return
        if score - mine < p.challenger_margin:
            self.rival, self.rival_wins = None, 0
            return
        self.rival_wins = self.rival_wins + 1 if self.rival == top["work"] else 1
        self.rival = top["work"]
        if self.rival_wins < p.challenger_windows:
            self.emit("challenger", top["work"], score)
            return
        self.release()
        self.state, self.pending, self.wins, self.weak = "candidate_lock", top["work"], 1, 0
        self.emit("switched", top["work"], old, "challenger")

    def window(self, now, silent, text):
        self.now = now
        if silent:
            self.silent, self.in_break = self.silent + 1, True
        else:
            if self.in_break:
                self.boost, self.in_break = 3, False
            self.silent = 0
        mode = self.mode()
        # What is heard is cleaned window by window, whatever the tracker does with it.
        text = "" if silent else clean(text, self.heard)
        if self.paused:
            self.emit("paused")
            return
        if silent:
            self.previous = ""
            self.rate *= 0.9
            self.quiet()
            return
        key = letters(text)
        self.rate = 0.65 * self.rate + 0.35 * (len(key) / C.SECONDS[mode])
        if self.state in ("searching", "candidate_lock"):
            if len(key) < 3:
                self.miss()
                return
            self.search(key, text)
        elif len(self.previous + key) < 3:
            self.state = "unstable_lock" if self.work is not None else self.state
            self.previous = key
            return
        else:
            self.follow(key, text)
        self.boost = max(0, self.boost - 1)
        self.previous = key

    def quiet(self):
        if self.state not in ("searching", "candidate_lock") or not self.armed or self.armed_left <= 0:
            return
        work, score = self.armed
        self.armed_left -= 1
        if self.armed_left == 0:
            self.armed = None
        if score < self.p.silence_score or self.silent > 2:
            return
        self.lock(work, score)
        self.boost = 0
        self.emit("silence_autolock", work, score)

    def mode(self):
        if self.boost > 0:
            return "start_boost"
        if self.state in ("locked", "unstable_lock"):
            if self.state == "unstable_lock" or self.weak > 0:
                return "locked_recover"
            return "locked_fast" if self.rate >= 1.5 else "locked_slow" if self.rate <= 0.65 else "locked_follow"
        return "search_fast" if self.rate >= 1.5 else "search"

    def command(self, now, name, arg):
        self.now = now
        if name in ("pause", "resume"):
            self.paused = name == "pause"
        elif name == "set_confidence_mode":
            self.p = C.PROFILES.get(arg, C.BALANCED)
        elif name == "manual_select":
            armed = self.armed, self.armed_left
            self.lock(int(arg), None)
            self.armed, self.armed_left = armed
        elif name == "navigate":
            self.emit("navigate", self.work, "prev" if arg == "prev" else "next")
            if self.work is not None:
                self.line = max(0, self.line - 1) if arg == "prev" else self.line + 1
        elif name == "force_unlock" and self.work is not None:
            old = self.work
            self.release()
            self.weak = 0
            self.emit("switched", None, old, "force_unlock")
        elif name == "recall":
            at = next((i for i, (w, _) in enumerate(self.history) if w == int(arg)), None)
            if at is not None:
                work, line = self.history.pop(at)
                if self.work is not None:
                    self.history.append((self.work, self.line))
                self.work, self.line, self.keys, self.state = work, line, self.corpus.keys.get(work, []), "locked"
                self.rival, self.rival_wins, self.pending, self.wins = None, 0, None, 0
                self.emit("display", work)
                self.emit("locked", work, None)


def play(corpus, windows, commands=()):
    """Events of one session: windows (idx, silent, text), commands (idx, name, arg) that come before them."""
    t = Tracker(corpus)
    steps = [(i, 0, ("command", i, n, a)) for i, n, a in commands] + [(i, 1, ("window", i, s, x)) for i, s, x in windows]
    for _, _, (kind, *args) in sorted(steps, key=lambda x: x[:2]):
        getattr(t, kind)(*args)
    return t.out

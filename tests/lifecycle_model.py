"""The lifecycle again, written from its description as a second-by-second simulation.

It shares no code with the fold: state is a dict, every sweep of every second is
run, and nothing is compacted.
"""

from __future__ import annotations

import math

PHASE1 = {"Critical": 5, "High": 20, "Medium": 15, "Low": 10}
BANS = [30, 60, 120, 300, 600, 1200]
SEVERITY = {"SYN Flood": 1.0, "ICMP Flood": 0.8, "UDP Flood": 0.9}
THR = 0.6092241858026261
ORDER = {"history": 0, "trip": 1, "result": 2, "hold": 3, "release": 4, "block": 5}


class Sim:
    def __init__(self):
        self.offences, self.s, self.k, self.watched, self.log = [], None, None, 0.0, []

    def rep(self, t):
        return min(round(sum(2.0 * 0.5 ** ((t - o[0]) / 86400.0) for o in self.offences), 4), 10.0)

    def tier(self, t, score, conf, vector, pps):
        x = score * conf + (SEVERITY.get(vector, 0.5) - 0.5) / 2 + min(0.2, 0.02 * self.rep(t))
        if pps > 10:
            x += min(0.15, math.log10(pps / 10) / 20)
        x = min(x, 1.0)
        return "Critical" if x >= .85 else "High" if x >= .65 else "Medium" if x >= .45 else "Low"

    def note(self, t, what, **kw):
        self.log.append((t, what, kw.get("level"), kw.get("count")))

    def new(self, t, phase, vector="Uncertain", score=0.0, conf=0.0, tier="Low", level=0, count=0, label="Quarantined"):
        self.s = dict(phase=phase, vector=vector, score=score, conf=conf, tier=tier, level=level, count=count, since=t,
                      label=label, end=None, pps=0.0, manual=False, rescored=False)

    def offence(self, t, level, count):
        self.offences.append((t, level, count))

    def to_black(self, t):
        s = self.s
        s.update(phase=3, since=t, label="Blackhole", end=t + 3600, count=min(s["count"] + 1, 5))
        self.offence(t, s["level"], s["count"])
        self.note(t, "Blackhole", level=s["level"], count=s["count"])

    def to_ban(self, t):
        s = self.s
        s["level"] = min(s["level"] + 1, 5)
        s["count"] = min(s["count"] + 1, 5)
        s.update(phase=2, since=t, label="Time Ban", end=t + BANS[s["level"]])
        self.offence(t, s["level"], s["count"])
        self.note(t, "Ban", level=s["level"], count=s["count"])

    def free(self, t, record=True, count=None):
        s, self.s = self.s, None
        if record:
            self.offence(t, s["level"], s["count"] if count is None else count)
        self.note(t, "Released", level=s["level"])

    def to_sink(self, t, vector, score, conf):
        if self.k is None:
            self.k = dict(vector=vector, score=score, conf=conf, since=t, pps=0.0)
            self.note(t, "Sinkhole")

    def divert(self, t):
        s, self.s = self.s, None
        self.offence(t, s["level"], s["count"])
        self.note(t, "Diverted")
        self.to_sink(t, s["vector"], s["score"], s["conf"])

    def again(self, t, score, vector, conf, level, count):
        tier = self.tier(t, score, conf, vector, 0)
        if self.rep(t) >= 10:
            self.new(t, 3, vector, score, conf, tier, min(level + 1, 5), count)
            self.to_black(t)
        else:
            self.new(t, 1, vector, score, conf, tier, level, count + 1)
            self.note(t, "Quarantined", level=level, count=count + 1)

    def fresh(self, t, score, vector, conf):
        tier = self.tier(t, score, conf, vector, 0)
        top = max((o[1] for o in self.offences), default=0)
        if self.rep(t) >= 10:
            self.new(t, 3, vector, score, conf, tier)
            self.to_black(t)
        elif top > 0:
            self.again(t, score, vector, conf, top, len(self.offences))
        elif tier == "High":
            self.new(t, 2, vector, score, conf, tier, 1, 1, "Time Ban")
            self.s["end"] = t + 60
            self.note(t, "Ban", level=1, count=1)
        else:
            self.new(t, 1, vector, score, conf, tier)
            self.note(t, "Quarantined", level=0, count=0)

    def more(self, t, vector, conf):
        s = self.s
        if s["manual"]:
            return
        if s["label"].startswith("Holding"):
            s["rescored"] = True
            self.note(t, "rescored")
        if conf > s["conf"]:
            s["vector"] = vector
        s["conf"] = conf
        if s["phase"] != 3 and self.rep(t) >= 10:
            self.to_black(t)

    def sweep(self, t):
        s, k = self.s, self.k
        if s and s["phase"] == 1 and t - s["since"] >= PHASE1[s["tier"]]:
            if s["score"] < THR or s["pps"] <= 1:
                self.free(t)
            elif s["vector"] == "Uncertain" and s["conf"] < .7:
                self.divert(t)
            elif self.rep(t) >= 10:
                self.to_black(t)
            else:
                self.to_ban(t)
        elif s and s["phase"] == 2 and s["end"] is not None and t >= s["end"]:
            held = s["label"].startswith("Holding")
            if held:
                self.note(t, "expired")
            if s["pps"] > 1 and s["score"] > 0 and s["score"] >= .8 * THR:
                self.to_black(t) if self.rep(t) >= 10 else self.to_ban(t)
            else:
                self.free(t, record=not held or s["rescored"], count=1)
        elif s and s["phase"] == 3 and s["end"] is not None and t >= s["end"]:
            self.free(t)
        if k and t - k["since"] >= 30:
            self.k = None
            self.watched += t - k["since"]
            if k["pps"] > 1 and (k["conf"] >= .7 or self.watched >= 90):
                self.watched = 0.0
                if self.s is None:
                    self.fresh(t, k["score"], k["vector"], k["conf"])
                elif not self.s["manual"]:
                    self.s["score"] = max(self.s["score"], k["score"])
                    self.more(t, k["vector"], k["conf"])
            else:
                self.note(t, "Unsunk")

    def event(self, t, kind, e):
        if kind == "history":
            self.offence(t, e["level"], e["count"])
        elif kind == "trip":
            if self.k:
                return
            if self.s:
                if e["both"] and self.s["phase"] == 1 and self.s["label"] == "Quarantined":
                    self.divert(t)
            elif e["both"]:
                self.to_sink(t, "Uncertain", 0.0, 0.0)
            else:
                self.new(t, 1)
                self.note(t, "Quarantined", level=0, count=0)
        elif kind == "result":
            self.result(t, e)
        elif kind == "hold":
            if self.s and self.s["manual"]:
                return
            if not self.s:
                self.new(t, 2)
            self.s.update(phase=2, since=t, label="Holding", end=t + 15, rescored=False)
            self.note(t, "held")
        elif kind == "release":
            if self.s:
                s, self.s = self.s, None
                self.offence(t, s["level"], s["count"])
                self.note(t, "Manual Release", level=s["level"])
            elif self.k:
                self.k, self.watched = None, 0.0
                self.note(t, "Unsunk")
        elif kind == "block":
            if not self.s:
                self.new(t, 3)
            self.s.update(phase=3, since=t, label="Blackhole", end=None, manual=True)
            self.note(t, "Manual Block")

    def result(self, t, e):
        hit = e["hit"]
        conf, vector = (e["conf"], e["vector"]) if hit else (0.0, "Normal")
        if self.k:
            self.k.update(pps=e["pps"], conf=conf, score=max(self.k["score"], e["score"]))
        s = self.s
        if s:
            s.update(score=max(s["score"], e["score"]), pps=e["pps"])
            c, v = (conf, vector) if s["phase"] == 1 and conf > s["conf"] else (s["conf"], s["vector"])
            s["tier"] = self.tier(t, s["score"], c, v, e["pps"])
        if not hit:
            return
        if s:
            self.more(t, vector, conf)
        elif self.offences and self.offences[-1][1] > 0:
            self.again(t, e["score"], vector, conf, self.offences[-1][1], self.offences[-1][2])
        else:
            self.fresh(t, e["score"], vector, conf)


def run(events, until):
    """events: (t, kind, dict) in order; sweeps run at every whole second."""
    sim, queue, clock = Sim(), sorted(events, key=lambda x: (x[0], ORDER[x[1]])), None
    if not queue:
        return []
    clock = math.floor(queue[0][0])
    for t, kind, e in queue:
        while clock + 1 <= t:
            clock += 1
            sim.sweep(clock)
        sim.event(t, kind, e)
    while clock + 1 <= until:
        clock += 1
        sim.sweep(clock)
    return sim.log

"""Edge exchange payoffs as column expressions over frame facts.

The values below are the model's fixed judgements; every score is a continuous function of frames and damage.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from boutline.functions.damage import unit

# fixed values of the model
TRADE_WINDOW = 4.0
PUNISH_SCALE = 30.0
COMMIT_SCALE = 25.0
DODGE_COST = 0.35
HIT_COST = (0.45, 1.00)     # offstage, at zero and at lethal damage
HIT_VALUE = (0.30, 1.00)    # opponent fresh, opponent at kill percent
DODGE = {"duration": 14, "invuln_start": 2, "cooldown": 163}
UNSURE = 0.3
DEFENDER = ("recovery", "airdodge", "doublejump", "contest", "stall")
ATTACKER = ("deep_dair", "ledge_sair", "gp", "wait", "retreat")
ATTACK_MOVE = {"deep_dair": "dair", "ledge_sair": "sair", "gp": "gp"}
DEFENDER_LABEL = {"recovery": "Recovery move", "airdodge": "Air dodge", "doublejump": "Double jump",
                  "contest": "Air attack (contest)", "stall": "Stall / drift"}


def p_first(mine: Column, theirs: Column) -> Column:
    """Chance the first startup lands before the second."""
    return 1.0 / (1.0 + F.exp(-(theirs - mine) / TRADE_WINDOW))


def punish(frames: Column, scale: float = PUNISH_SCALE) -> Column:
    return unit(frames / scale)


def _between(ends, damage: Column) -> Column:
    return F.lit(ends[0]) + (ends[1] - ends[0]) * F.coalesce(unit(damage), F.lit(0.5))


def hit_cost(damage: Column) -> Column:
    """Cost of being hit at one's damage; unknown damage counts as half."""
    return _between(HIT_COST, damage)


def hit_value(damage: Column) -> Column:
    """Worth of a hit at the opponent's damage; unknown damage counts as half."""
    return _between(HIT_VALUE, damage)


class Exchange:
    """Cells of one exchange. ``mine`` and ``theirs`` are structs {move: {startup, whiff, known}}."""

    def __init__(self, mine: Column, theirs: Column, my_damage: Column, their_damage: Column):
        self.mine, self.theirs = mine, theirs
        self.cost, self.value = hit_cost(my_damage), hit_value(their_damage)

    def cell(self, d: str, a: str) -> tuple[Column, Column, Column]:
        """Score in [-1, 1] for the defender, the reason, and the confidence."""
        if a in ATTACK_MOVE:
            return self._committed(d, self.theirs[ATTACK_MOVE[a]], ATTACK_MOVE[a])
        return self._waiting(d) if a == "wait" else self._retreating(d)

    def _sure(self, *moves):
        ok = F.lit(True)
        for m in moves:
            ok = ok & m["known"]
        return F.when(ok, F.lit(1.0)).otherwise(F.lit(UNSURE))

    def _trade(self, move, hit, gain, extra):
        """A contested exchange: who lands first, what landing is worth, what losing costs."""
        own = self.mine[move]
        p = p_first(own["startup"], hit["startup"])
        score = p * self.value * (gain[0] + gain[1] * punish(hit["whiff"], COMMIT_SCALE)) - (1 - p) * (self.cost + extra(own))
        why = F.format_string("%s f%d vs their f%d, %d%% to land first, %df of own lag", F.lit(move), own["startup"],
                              hit["startup"], F.rint(p * 100).cast("long"), own["whiff"])
        return score, why, self._sure(own, hit)

    def _committed(self, d, hit, name):
        opening = punish(hit["whiff"], COMMIT_SCALE)
        if d == "recovery":
            return self._trade("recovery", hit, (0.60, 0.60), lambda own: F.lit(0.0))
        if d == "contest":
            return self._trade("sair", hit, (0.55, 0.55), lambda own: 0.15 * punish(own["whiff"]))
        sure = self._sure(hit)
        if d == "airdodge":
            score = 0.90 * self.value * (0.35 + 0.55 * opening) - 0.10 * self.cost - DODGE_COST * 0.5
            return score, F.format_string("invulnerable from f%d for %df, they recover %df, dodge back in %df",
                                          F.lit(DODGE["invuln_start"]), F.lit(DODGE["duration"]), hit["whiff"], F.lit(DODGE["cooldown"])), sure
        if d == "doublejump":
            evade = 0.55 + 0.35 * opening
            return (evade * 0.30 - (1 - evade) * self.cost,
                    F.format_string("movement can make it whiff, %df to use but nothing to hit with", hit["whiff"]), sure)
        return -0.25 - 0.75 * self.cost, F.format_string("their %s lands f%d and nothing answers it", F.lit(name), hit["startup"]), sure

    def _waiting(self, d):
        if d in ("recovery", "contest"):
            own = self.mine["recovery" if d == "recovery" else "sair"]
            base, scale = (-0.15, 0.85) if d == "recovery" else (-0.20, 0.80)
            return (base - scale * punish(own["whiff"]) * self.cost,
                    F.format_string("nothing to hit, then %df of lag to punish", own["whiff"]), self._sure(own))
        score = {"airdodge": -0.30 - DODGE_COST - 0.35 * self.cost, "doublejump": 0.10 + 0.45 * self.cost,
                 "stall": 0.20 - 0.20 * self.cost}[d]
        why = {"airdodge": f"dodge spent on nothing, {DODGE['cooldown']}f until the next",
               "doublejump": f"keeps the dodge ({DODGE['cooldown']}f) and the recovery", "stall": "costs drift only"}[d]
        return score, F.lit(why), F.lit(1.0)

    def _retreating(self, d):
        if d == "recovery":
            own = self.mine["recovery"]
            return 0.35 + 0.25 * self.cost, F.format_string("free recovery f%d, %df nobody punishes", own["startup"], own["whiff"]), self._sure(own)
        if d == "contest":
            own = self.mine["sair"]
            return F.lit(0.0), F.format_string("hits empty air, %df unpunished", own["whiff"]), self._sure(own)
        score = {"airdodge": 0.20 - DODGE_COST * 0.5 * self.cost, "doublejump": 0.40 + 0.25 * self.cost, "stall": 0.25 + 0.10 * self.cost}[d]
        why = {"airdodge": f"safe, but the dodge is gone for {DODGE['cooldown']}f", "doublejump": "free return, every option left",
               "stall": "free repositioning"}[d]
        return score, F.lit(why), F.lit(1.0)

    def rows(self) -> Column:
        """All cells as array<struct<d, ord, row_confidence, a, score, why, confidence>>."""
        out = []
        for i, d in enumerate(DEFENDER):
            cells = [(a, *self.cell(d, a)) for a in ATTACKER]
            worst = F.least(*[c[3] for c in cells])
            out += [F.struct(F.lit(d).alias("d"), F.lit(i).alias("ord"), worst.alias("row_confidence"), F.lit(a).alias("a"),
                             s.cast("double").alias("score"), w.alias("why"), c.alias("confidence")) for a, s, w, c in cells]
        return F.array(*out)

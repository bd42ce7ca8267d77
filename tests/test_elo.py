"""The registered Elo queries against the fold of the reference's rules over all games."""

from collections import defaultdict

import __spark_entry__ as entry
from pitchlake.plans import catalogue
from pitchlake.sources import league

K, MARGIN, CAP, SCALE = 24, 0.2, 6, 400


def folded(games):
    """Up to 30 passes over games in order, until the mean change of side A is below 1.0."""
    games = [g for g in games if g.score_a is not None and g.score_b is not None]
    games.sort(key=lambda g: (g.date, g.game_id, g.team_a, g.team_b, g.score_a, g.score_b))
    played, r = defaultdict(int), {}
    for g in games:
        for t in (g.team_a, g.team_b):
            played[t] += 1
            r[t] = 1500.0
    for _ in range(30):
        total = 0.0
        for g in games:
            a, b, gd = g.team_a, g.team_b, g.score_a - g.score_b
            expected = 1 / (1 + 10 ** ((r[b] - r[a]) / SCALE))
            change = K * (1 + MARGIN * min(abs(gd), CAP)) * ((gd > 0) + 0.5 * (gd == 0) - expected)
            wide = max(r.values()) - min(r.values())
            gap = (r[a] - r[b]) / wide if wide else 0.0
            up = change * min(1.0, (played[a] / 8) ** 0.6) / (1 + max(0.0, gap) ** 0.5)
            r[a] += up
            r[b] -= change * min(1.0, (played[b] / 8) ** 0.6) / (1 + max(0.0, -gap) ** 0.5)
            total += abs(up)
        if total / len(games) < 1.0:
            break
    return r


def test_elo_queries_settle_over_all_games(spark):
    lg = league.load(spark, entry.SMOKE_DIR)
    games = lg.games.collect()
    age = {t.team: t.age for t in lg.teams.collect()}
    want = {(d, t): x for d in set(age.values()) for t, x in folded([g for g in games if age.get(g.team_a) == d]).items()}
    got = {(r.division, r.team): r.rating for r in catalogue.QUERIES["elo_sequential"](spark, entry.SMOKE_DIR).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    ratings, theirs = folded(games), defaultdict(list)
    for g in games:
        theirs[g.team_a].append(ratings[g.team_b])
        theirs[g.team_b].append(ratings[g.team_a])
    got = {r.team: r.sos_iterative for r in catalogue.QUERIES["elo_schedule"](spark, entry.SMOKE_DIR).collect()}
    assert got.keys() == theirs.keys() and all(abs(got[t] - sum(x) / len(x)) < 1e-5 for t, x in theirs.items())


def test_games_are_read_in_runs(monkeypatch):
    """A division's games come in several batches and are folded from its file, whatever the run."""
    import random
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd
    import pytest

    from pitchlake.operators import elo

    rng = random.Random(3)
    rows = [(d, *rng.sample(range(40, 52), 2), rng.randrange(5), rng.randrange(5)) for d in "xy" for _ in range(90)]
    table = pd.DataFrame(rows, columns=["division", "team_a", "team_b", "score_a", "score_b"])
    seen = []
    for division, teams, file in elo._divisions(table.iloc[i : i + 25] for i in range(0, len(table), 25)):

        def runs(file=file):
            file.seek(0)
            while block := file.read(7 * elo.GAME.itemsize):
                yield np.frombuffer(block, elo.GAME)

        games = [SimpleNamespace(date=0, game_id=i, team_a=a, team_b=b, score_a=p, score_b=q) for i, (d, a, b, p, q) in enumerate(rows) if d == division]
        assert dict(zip(teams, elo.replay(runs, len(teams)))) == {t: pytest.approx(v, abs=1e-7) for t, v in folded(games).items()}
        seen.append(division)
    assert seen == ["x", "y"]

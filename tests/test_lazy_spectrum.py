"""A run whose step count is given does not compute a spectrum that nobody reads."""

import pytest

from linktide.operators import focus as FO


def test_spectrum_is_made_when_read(spark, make_links, monkeypatch):
    adj = make_links([(1, 2, 5), (2, 3, 7), (3, 1, 2), (3, 4, 1)]).selectExpr("src", "dst", "cast(amount AS double) AS w")
    params = FO.FocusParams(tau=0.02, krylov_steps=3)
    want = FO.focus(adj, params).spectrum
    calls, real = [], FO.spectrum
    monkeypatch.setattr(FO, "spectrum", lambda *given: calls.append(1) or real(*given))
    done = FO.focus(adj, params, steps=1)
    assert done.nodes.count() == 4 and not calls
    assert done.spectrum.lambda_max == pytest.approx(want.lambda_max) and done.spectrum.steps == want.steps
    assert calls == [1]

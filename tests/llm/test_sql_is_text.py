from surestat.llm.queries import ORACLES


def test_every_oracle_is_sql():
    assert ORACLES and all(isinstance(x, str) for x in ORACLES.values())

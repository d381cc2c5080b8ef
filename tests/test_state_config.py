import json

import pytest

from tidelog import config
from tidelog.errors import DecodeError, InvalidPositionError, SourceError, source_error
from tidelog.operators.state import Checkpointer, Repository, SourceState, gtid_within, with_retries


def states(*offsets):
    return [SourceState(last_offset=o) for o in offsets]


def test_history_is_bounded_and_kept(spark, tmp_path):
    c = Checkpointer(Repository(spark, str(tmp_path / "s")), capacity=2)
    for s in states(1, 2, 3, 4):
        c.add(s)
    assert [s.last_offset for s in Checkpointer(Repository(spark, str(tmp_path / "s"))).history] == [3, 4]
    c.capacity = 9
    c.history = states(1, 2, 3)
    assert c.remove_last(2).last_offset == 2
    assert [s.last_offset for s in c.history] == [1]
    for n in (0, -1, 2):
        with pytest.raises(ValueError, match="cannot remove"):
            c.remove_last(n)


def test_reset_goes_back_further_each_time(spark, tmp_path):
    c = Checkpointer(Repository(spark, str(tmp_path / "s")))
    c.history = states(1, 2, 3)
    assert [c.reset().last_offset, c.reset().last_offset] == [3, 1]
    assert c.reset() == SourceState() and c.history == []
    assert c.commit({"ts_ms": 1, "offset": 5, "last_position": "p"}) and c.step == 1


def test_saves_are_fenced(spark, tmp_path):
    c = Checkpointer(Repository(spark, str(tmp_path / "s")))
    assert c.save(SourceState(leader_epoch=5))
    assert not c.save(SourceState(leader_epoch=4, last_offset=9))
    assert c.save(SourceState(leader_epoch=5, last_offset=1)) and c.save(SourceState(leader_epoch=6, last_offset=2))
    assert Checkpointer(Repository(spark, str(tmp_path / "s"))).state() == SourceState(leader_epoch=6, last_offset=2)


def test_checkpoints_only_advance(spark, tmp_path):
    c = Checkpointer(Repository(spark, str(tmp_path / "s")))
    c.save(SourceState(last_offset=12, server_uuid="U", gtid_set="u:1-5"))
    m = {"ts_ms": 23, "offset": 13, "last_position": "a.1:2:3", "server_uuid": "u", "gtid_set": "u:1-6"}
    assert not c.commit(None) and not c.commit(m | {"offset": 0}) and not c.commit(m | {"gtid_set": "u:1-5"}) and not c.commit(m | {"server_uuid": "v", "gtid_set": "u:2-3"})
    assert c.commit(m)
    assert c.state() == SourceState(23, 13, 0, "a.1:2:3", "u", "u:1-6") and len(c.history) == 1
    assert c.commit(m | {"server_uuid": "v", "offset": 1, "gtid_set": "u:1-7"})  # another server: by ids


def test_a_replaced_leader_cannot_save(spark, tmp_path):
    old, new = (Checkpointer(Repository(spark, str(tmp_path / "s")), leader_epoch=e) for e in (1, 2))
    m = {"ts_ms": 1, "offset": 5, "last_position": "p"}
    assert old.commit(m) and new.commit(m | {"offset": 9})  # the new one has not seen what the old one has saved
    assert not old.commit(m | {"offset": 50})  # nor the old one the new one's, but the repository has
    assert old.state().last_offset == 9 and Checkpointer(Repository(spark, str(tmp_path / "s"))).state().leader_epoch == 2


def test_unknown_fields_are_ignored():
    assert SourceState.from_json(json.dumps({"last_offset": 3, "later": 1})) == SourceState(last_offset=3)
    assert gtid_within("A:1-3,a:4", "a:1-9") and not gtid_within("b:1", "a:1-9") and gtid_within("", "")


def test_repository(spark, tmp_path):
    r = Repository(spark, str(tmp_path / "r"))
    assert not r.exists()
    r.update(1, lambda a, b: a + b)
    r.update(2, lambda a, b: a + b)
    assert r.get() == 3
    with pytest.raises(FileExistsError):
        r.create(5)
    r.remove()
    r.create(5)
    assert r.get() == 5


def test_errors():
    assert isinstance(source_error("1236; could not find first log file"), InvalidPositionError)
    assert type(source_error("2013; lost connection")) is SourceError
    assert "t.c" in str(DecodeError("bad", "t", "c"))


def test_retries():
    calls, waits = [], []

    def fail_twice():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return "done"

    assert with_retries(fail_twice, sleep=waits.append) == "done"
    assert waits == [0.004, 0.008]
    with pytest.raises(RuntimeError):
        with_retries(lambda: (_ for _ in ()).throw(RuntimeError()), seconds=1, sleep=waits.append)
    with pytest.raises(KeyError):
        with_retries(lambda: {}["x"])


YAML = """
mysql-user: u
mysql-server-id: 65535
unknown: 1
mysql-schema-store: {host: h}
mysql-sources:
  - {name: test, host: localhost, port: 3306, tables: ["test_db:a", "test_db:b", "o:c"], host_role: replica, socket_timeout_seconds: -1, ssl_mode: required, mtls_enabled: true, later: x,
     destination: {pool_size: 5, buffer_size: 1000}}
"""


def test_configuration():
    c = config.load(YAML)
    s = c.mysql_sources[0]
    assert (s.port, s.host_role, s.ssl_mode, s.socket_timeout_seconds, s.destination.pool_size, s.destination.buffer_size, s.destination.type) == (3306, "REPLICA", "REQUIRED", -1, 5, 1000, "kafka")
    assert s.databases == ["test_db", "o"] and s.effective_server_id(c.mysql_server_id) == 65635
    assert c.mysql_schema_store.host == "h"


@pytest.mark.parametrize("bad", [{"tables": []}, {"port": 0}, {"host_role": "x"}, {"host_role": "migration", "destination": {"pool_size": 1}}, {"destination": {"buffer_size": -1}}])
def test_bad_configuration(bad):
    with pytest.raises(ValueError):
        config.SourceConfig(**({"name": "n", "tables": ["a:b"], "host": "h"} | bad))


def test_registered_history_keeps_fifty_states(spark, tmp_path):
    from tidelog.plans import registry

    spark.range(60).selectExpr("'s' as source_id", "id as state_id").write.parquet(f"{tmp_path}/source_states.parquet")
    kept = registry.queries()["o60_kept_history_full"](spark, str(tmp_path)).collect()
    assert sorted(r.state_id for r in kept) == list(range(10, 60))

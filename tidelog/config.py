"""Configuration of sources, destinations and pipes from YAML. Unknown settings are ignored."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

import yaml

ROLES = {"MASTER": 0, "REPLICA": 1, "MIGRATION": 2}
SSL_MODES = ("DISABLED", "PREFERRED", "REQUIRED", "VERIFY_CA", "VERIFY_IDENTITY")


def _pick(kind: type, data: dict | None) -> dict:
    """Settings that the class knows; keys may be spelled with - or _."""
    known = {f.name for f in fields(kind)}
    return {k2: v for k, v in (data or {}).items() if (k2 := k.replace("-", "_")) in known}


@dataclass
class DestinationConfig:
    """buffer_size: batches held back (0: none); pool_size: members that a batch is spread over (0: none)."""

    type: str = "kafka"
    buffer_size: int = 0
    pool_size: int = 0
    producer_config: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.buffer_size < 0 or self.pool_size < 0:
            raise ValueError("buffer_size and pool_size must not be negative")


@dataclass
class SourceConfig:
    """One replicated server. tables: names as database:table."""

    name: str
    tables: list[str]
    host: str
    port: int = 5672
    host_role: str = "MASTER"
    server_id: int = -1
    socket_timeout_seconds: int = 90
    schema_version_enabled: bool = False
    initial_binlog_position: str = "latest"
    delay_send_ms: int = 0
    overriding_database: str | None = None
    ssl_mode: str = "DISABLED"
    mtls_enabled: bool = False
    large_message_enabled: bool = False
    destination: DestinationConfig = field(default_factory=DestinationConfig)

    def __post_init__(self) -> None:
        if isinstance(self.destination, dict):
            self.destination = DestinationConfig(**_pick(DestinationConfig, self.destination))
        self.host_role, self.ssl_mode = self.host_role.upper(), self.ssl_mode.upper()
        if not self.tables:
            raise ValueError(f"source {self.name} has no tables")
        if self.host_role not in ROLES or self.ssl_mode not in SSL_MODES or not 1 <= self.port <= 65535:
            raise ValueError(f"source {self.name}: bad host_role, ssl_mode or port")
        if self.host_role == "MIGRATION" and self.destination.pool_size > 0:
            raise ValueError(f"source {self.name}: a migration cannot have a pool of destinations")

    @property
    def databases(self) -> list[str]:
        return list(dict.fromkeys(t.partition(":")[0] for t in self.tables))

    def effective_server_id(self, default: int) -> int:
        """The source's own id, or the global one, shifted by the role."""
        return (self.server_id if self.server_id != -1 else default) + 100 * ROLES[self.host_role]


@dataclass
class SchemaStoreConfig:
    host: str
    port: int = 3306
    database: str = "schema_store"
    archive_database: str = "schema_store_archives"


@dataclass
class Config:
    mysql_user: str = ""
    mysql_password: str = ""
    mysql_server_id: int = 65535
    mysql_sources: list[SourceConfig] = field(default_factory=list)
    kafka_config: dict = field(default_factory=dict)
    mysql_schema_store: SchemaStoreConfig | None = None
    tls_config: dict | None = None
    state_path: str = "state"


def load(text: str) -> Config:
    """Configuration from YAML text."""
    config = Config(**_pick(Config, yaml.safe_load(text)))
    config.mysql_sources = [SourceConfig(**_pick(SourceConfig, s)) for s in config.mysql_sources]
    if isinstance(config.mysql_schema_store, dict):
        config.mysql_schema_store = SchemaStoreConfig(**_pick(SchemaStoreConfig, config.mysql_schema_store))
    return config

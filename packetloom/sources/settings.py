"""A sensor's settings: typed, with defaults, checked; from a dict or a YAML file."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

MODES = ("libpcap", "af_packet", "af_xdp")


@dataclass(frozen=True)
class Sensor:
    name: str
    environment: str = "production"
    log_level: str = "info"
    tenant_id: str | None = None


@dataclass(frozen=True)
class Capture:
    interface: str
    mode: str = "libpcap"
    promisc: bool = True
    snap_len: int = 65535


@dataclass(frozen=True)
class Dissectors:
    tcp: bool = True
    udp: bool = True
    icmp: bool = True
    dns: bool = True
    http: bool = True
    tls: bool = True
    ntp: bool = True
    dhcp: bool = True
    modbus: bool = False
    dnp3: bool = False
    bacnet: bool = False
    ethernet_ip: bool = False


@dataclass(frozen=True)
class Pcap:
    enabled: bool = False
    trigger: str = "alert"
    ring_buffer_mb: int = 512
    retention_days: int = 7


@dataclass(frozen=True)
class Ips:
    enabled: bool = False
    mode: str = "tap"
    default_action: str = "pass"


@dataclass(frozen=True)
class Listener:
    port: int
    enabled: bool = False
    protocol: str = "udp"
    host: str = "0.0.0.0"


@dataclass(frozen=True)
class Inputs:
    syslog: Listener | None = None
    netflow: Listener | None = None
    snmp: Listener | None = None
    ipfix: Listener | None = None
    wef: Listener | None = None
    http_webhook: Listener | None = None


@dataclass(frozen=True)
class Mtls:
    enabled: bool = False
    cert: str | None = None
    key: str | None = None
    ca: str | None = None


@dataclass(frozen=True)
class Kafka:
    brokers: tuple[str, ...]
    topic: str = "ge.raw.logs"
    mtls: Mtls | None = None


@dataclass(frozen=True)
class DeadLetters:
    enabled: bool = False
    path: str = "dead-letters"
    max_gb: int = 10
    retention_days: int = 7


@dataclass(frozen=True)
class Output:
    kafka: Kafka
    dlq: DeadLetters | None = None


@dataclass(frozen=True)
class Settings:
    sensor: Sensor
    capture: Capture
    output: Output
    dissectors: Dissectors = field(default_factory=Dissectors)
    pcap: Pcap = field(default_factory=Pcap)
    ips: Ips = field(default_factory=Ips)
    inputs: Inputs = field(default_factory=Inputs)


def built(kind: Any, given: Any, where: str = "settings") -> Any:
    """A dataclass of this kind from a dict; unknown keys are ignored, missing ones take defaults."""
    options = [k for k in getattr(kind, "__args__", ()) if is_dataclass(k)]
    if options:
        return None if given is None else built(options[0], given, where)
    if not is_dataclass(kind):
        return tuple(given) if isinstance(given, list) else given
    if not isinstance(given, dict):
        raise ValueError(f"{where}: expected named fields")
    hints = get_type_hints(kind)
    values = {f.name: built(hints[f.name], given[f.name], f"{where}.{f.name}") for f in fields(kind) if f.name in given}
    try:
        return kind(**values)
    except TypeError as e:
        raise ValueError(f"{where}: {e}") from None


def checked(given: dict) -> Settings:
    """Settings from a dict; ValueError for what isn't allowed."""
    s = built(Settings, given)
    if not s.sensor.name:
        raise ValueError("sensor name must not be empty")
    if not s.capture.interface:
        raise ValueError("capture interface must not be empty")
    if s.capture.mode not in MODES:
        raise ValueError(f"capture mode must be one of: {', '.join(MODES)}")
    if not 64 <= s.capture.snap_len <= 65535:
        raise ValueError("snap_len must be 64..65535")
    if not s.output.kafka.brokers:
        raise ValueError("at least one Kafka broker is required")
    return s


def load(path: str) -> Settings:
    """Settings from a YAML file; needs PyYAML."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return checked(yaml.safe_load(f) or {})

"""Label taxonomy: fine labels, the coarse classes and the rules between them."""

from __future__ import annotations

from dataclasses import dataclass, field

# The eight classes, in model output order.
CLASSES = (
    "Benign",
    "DDoS",
    "DoS",
    "Mirai",
    "Recon",
    "Spoofing",
    "Web",
    "BruteForce",
)

# Fine label -> class of the public CICIoT2023 data set.
FINE_TO_CLASS = {
    "BenignTraffic": "Benign",
    "DDoS-RSTFINFlood": "DDoS",
    "DDoS-PSHACK_Flood": "DDoS",
    "DDoS-SYN_Flood": "DDoS",
    "DDoS-UDP_Flood": "DDoS",
    "DDoS-TCP_Flood": "DDoS",
    "DDoS-ICMP_Flood": "DDoS",
    "DDoS-SynonymousIP_Flood": "DDoS",
    "DDoS-ACK_Fragmentation": "DDoS",
    "DDoS-UDP_Fragmentation": "DDoS",
    "DDoS-ICMP_Fragmentation": "DDoS",
    "DDoS-SlowLoris": "DDoS",
    "DDoS-HTTP_Flood": "DDoS",
    "DoS-UDP_Flood": "DoS",
    "DoS-SYN_Flood": "DoS",
    "DoS-TCP_Flood": "DoS",
    "DoS-HTTP_Flood": "DoS",
    "Mirai-greeth_flood": "Mirai",
    "Mirai-greip_flood": "Mirai",
    "Mirai-udpplain": "Mirai",
    "Recon-PingSweep": "Recon",
    "Recon-OSScan": "Recon",
    "Recon-PortScan": "Recon",
    "Recon-HostDiscovery": "Recon",
    "VulnerabilityScan": "Recon",
    "MITM-ArpSpoofing": "Spoofing",
    "DNS_Spoofing": "Spoofing",
    "SqlInjection": "Web",
    "XSS": "Web",
    "CommandInjection": "Web",
    "Backdoor_Malware": "Web",
    "Uploading_Attack": "Web",
    "BrowserHijacking": "Web",
    "DictionaryBruteForce": "BruteForce",
}

# Prefixes tried in this order for fine labels not listed above.
PREFIX_TO_CLASS = (
    ("DDoS-", "DDoS"),
    ("DoS-", "DoS"),
    ("Mirai-", "Mirai"),
    ("Recon-", "Recon"),
)


@dataclass(frozen=True)
class Taxonomy:
    """Coarse classes plus the explicit map and prefix rules leading to them."""

    classes: tuple[str, ...] = CLASSES
    explicit: dict[str, str] = field(default_factory=lambda: dict(FINE_TO_CLASS))
    prefixes: tuple[tuple[str, str], ...] = PREFIX_TO_CLASS
    benign: str = "Benign"


DEFAULT_TAXONOMY = Taxonomy()

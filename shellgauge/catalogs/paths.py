"""Path catalogs: which locations are roots, critical, secret or sensitive."""

from __future__ import annotations

# Fixed values: (pattern, bears secrets, extension id); the first match wins.
CRITICAL: list[tuple[str, bool, str | None]] = [
    (r"^/dev/(sd|hd|nvme|vd|md|mmcblk|loop)", False, None),
    (r"/etc/(shadow|gshadow|sudoers)(\s|$|/)", True, None),
    (r"\.ssh/authorized_keys", True, None),
    (r"\.ssh/id_(rsa|ed25519|ecdsa|dsa)\b", True, None),
    (r"/proc/(sysrq-trigger|kallsyms|kcore|kmsg|self/mem|kmem)\b", False, None),
    (r"/sys/kernel/(kexec|debug|tracing|security)\b", False, None),
    (r"^/dev/r?disk[0-9]", False, "EXT-005"),
]

# Fixed values: (prefix, extension id).
SECRET: list[tuple[str, str | None]] = [
    ("~/.ssh/id_", None), ("~/.ssh/authorized_keys", None), ("~/.aws/credentials", None),
    ("~/.docker/config.json", None), ("~/.kube/config", None), ("~/.gnupg/", None),
    ("~/.netrc", None), ("~/.mysql_history", None), ("/etc/shadow", None),
    ("/etc/gshadow", None), ("/etc/sudoers", None), ("/root/.ssh", None),
    ("~/Library/Keychains/", "EXT-001"), ("/Library/Keychains/", "EXT-001"),
]

# Fixed values: (prefix, extension id).
SENSITIVE: list[tuple[str, str | None]] = [
    ("/etc/", None), ("/boot/", None), ("/sys/", None), ("/proc/sys/", None), ("/root/", None),
    ("/var/log/", None), ("/var/lib/", None), ("/dev/", None), ("/System/", "EXT-003"),
    ("/Library/LaunchAgents/", "EXT-003"), ("/Library/LaunchDaemons/", "EXT-003"),
    ("/Library/StartupItems/", "EXT-003"), ("~/Library/LaunchAgents/", "EXT-003"),
]

# Prefixes that end the checks for a path.
BENIGN_DEVICES = """
    /dev/null /dev/zero /dev/random /dev/urandom /dev/stdout /dev/stderr /dev/stdin /dev/tty
    /dev/pts/ /dev/fd/
""".split()

# Exact targets of destructive heads; the second group is EXT-004.
SYSTEM_ROOTS = "/ /* /home /etc /usr /var /opt /srv /boot /bin /sbin /lib /lib64".split()
SYSTEM_ROOTS_EXT004 = "/System /Library /Applications /Users /private /Volumes".split()

# Heads by access.
READ_HEADS = """
    cat head tail less more wc nl od xxd hexdump strings grep egrep fgrep rg ag ack
    find locate which whereis type ls ll dir tree file stat readlink realpath du df
    awk sed cut sort uniq tr column paste diff cmp jq yq echo printf ps top htop
    free uptime date uname id whoami hostname env printenv md5sum sha1sum sha256sum
    mount rsync
""".split()
WRITE_HEADS = """
    cp mv mkdir touch ln rm rmdir dd mkfs shred wipefs fdisk truncate fallocate
    chmod chown chgrp setcap tar zip unzip gzip gunzip apt apt-get yum dnf pacman
    npm pip pip3 make gcc g++ cmake git
""".split()
DESTRUCTIVE_HEADS = "rm dd mkfs shred wipefs fdisk parted gdisk sgdisk cfdisk truncate".split()

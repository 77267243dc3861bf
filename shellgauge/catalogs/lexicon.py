"""Command-head lexicon: which risk class the first word of a command has."""

from __future__ import annotations

# Base score of every risk class, in class order.
CLASS_BASE: dict[str, float] = {
    "READ_ONLY": 0.00,
    "WRITE_LOCAL": 0.15,
    "WRITE_SENSITIVE": 0.70,
    "NETWORK_FETCH": 0.40,
    "EXECUTION_CHAIN": 0.60,
    "PRIVILEGE_OR_PERMISSION": 0.75,
    "PERSISTENCE": 0.80,
    "DESTRUCTIVE": 1.00,
    "RESOURCE_ABUSE": 0.85,
    "UNKNOWN": 0.35,
}

# Heads per risk class, whitespace separated. Heads not listed are UNKNOWN.
HEADS_BY_CLASS: dict[str, str] = {
    "READ_ONLY": """
        cat head tail less more wc nl od hexdump xxd strings grep egrep fgrep rg ag
        ack find locate which whereis type command ls ll dir tree file stat readlink
        realpath pwd whoami id groups w who last tty uname hostname date uptime cal
        lsb_release df du free top htop atop iotop env printenv echo printf yes diff
        cmp comm sort uniq cut tr awk sed jq yq xmllint column paste join tac rev
        man help info tldr whatis md5sum sha1sum sha256sum sha512sum b2sum cksum
        true false test [ history bc dc seq expr sleep ping traceroute mtr host dig
        nslookup ps pgrep pidof jobs pstree
    """,
    "WRITE_LOCAL": """
        cp mv mkdir touch ln tar zip unzip gzip gunzip bzip2 xz 7z zstd tee make
        cmake gradle mvn ant ninja bazel pip pip3 npm yarn pnpm cargo go poetry
        python python3 node ruby perl php lua git docker podman docker-compose
        kubectl helm export alias unalias pytest tox nose2 rspec jest mocha vitest
        gcc g++ clang javac rustc tsc vi vim nvim nano emacs
    """,
    "NETWORK_FETCH": """
        curl wget httpie aria2c rsync scp sftp ftp apt apt-get yum dnf pacman brew
        snap flatpak nc ncat netcat ssh
    """,
    "EXECUTION_CHAIN": """
        bash sh zsh dash ksh csh tcsh ash exec source .
    """,
    "PRIVILEGE_OR_PERMISSION": """
        sudo su doas pkexec chmod chown chgrp setcap getcap visudo passwd chpasswd
        useradd userdel usermod groupadd groupdel groupmod newgrp adduser deluser
    """,
    "PERSISTENCE": """
        crontab at batch anacron systemctl service update-rc.d chkconfig launchctl
    """,
    "DESTRUCTIVE": """
        rm rmdir dd mkfs mkfs.ext4 mkfs.ext3 mkfs.xfs mkfs.btrfs mkfs.vfat fdisk
        parted gdisk sgdisk cfdisk shred wipe wipefs blkdiscard truncate
    """,
    "RESOURCE_ABUSE": """
        kill killall pkill shutdown reboot halt poweroff init telinit stress
        stress-ng fallocate nmap hping3 masscan
    """,
}

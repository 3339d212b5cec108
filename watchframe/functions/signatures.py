"""Detection word lists and thresholds.

Everything in this module is a fixed value: the detection results depend on
these exact strings, so they are stated plainly and kept verbatim.  Some
entries hold capitals or a literal ``*`` and can therefore never match a
lower-cased name or path; they are kept as they are (see README, "Kept
quirks").
"""

# -- fixed values: names of attack tools, per category ----------------------

CREDENTIAL_TOOLS = [
    "mimikatz.exe", "mimikatz", "wce.exe", "fgdump.exe", "pwdump.exe", "gsecdump.exe",
    "lsadump.exe", "procdump.exe", "samdump2", "cachedump.exe", "creddump", "creddump7",
    "creddump8", "quarkspwdump.exe", "pwddump", "pwdump7.exe", "pwdump8.exe", "dcdiag.exe",
    "ntdsutil.exe", "vssadmin.exe", "dsamain.exe", "secretsdump.py", "impacket-secretsdump",
    "lsassy", "spraykatz", "kerbrute", "kerberoast", "asreproast", "ruby_smb", "crackmapexec",
    "netripper", "katz.exe", "lazagne.exe", "lazagne", "browserpass", "webpass",
    "mailpassview", "networkpassview", "chromepass", "iepassview", "protectedstorage",
    "dpapi", "sharpdpapi", "donpapi",
]

SCANNER_TOOLS = [
    "nmap", "nmap.exe", "masscan", "masscan.exe", "zmap", "zmap.exe", "rustscan", "naabu",
    "naabu.exe", "unicornscan", "angryip", "advanced_port_scanner", "netscan", "zenmap",
    "p0f", "amass", "subfinder", "httpx", "gobuster", "dirb", "wfuzz", "ffuf", "dirbuster",
]

EXPLOIT_TOOLS = [
    "msfconsole", "msf", "msfvenom", "metasploit", "msfcli", "cobalt_strike", "beacon.exe",
    "cs_beacon", "teamserver", "meterpreter", "shellcode", "payload.exe", "sliver",
    "sliver-server", "sliver-client", "havoc", "havoc_c2", "mythic", "apfell", "poseidon",
    "bruteratel", "brute_ratel", "covenant", "grunt", "empire", "powershellempire",
    "starkiller", "pwn", "pwntools", "exploit.exe", "shellter", "veil", "veil-evasion",
    "shellter.exe", "encoder.exe", "av_evasion", "pe_to_shellcode", "donut", "donut.exe",
    "scrobj", "sctobjs",
]

POST_EXPLOIT_TOOLS = [
    "psexec.exe", "psexec64.exe", "psexecsvc.exe", "wmiexec", "wmiexec.exe", "wmic.exe",
    "wmic", "smbexec", "smbexec.py", "smbexec.exe", "atexec", "atexec.py", "atexec.exe",
    "dcomexec", "dcomexec.py", "impacket", "impacket.exe", "impacket_smb", "remcom",
    "pth-winexe", "winexe", "evil-winrm", "evil_winrm", "winrm.vbs", "xfreerdp", "freerdp",
    "remmina", "putty.exe", "plink.exe", "ssh.exe", "mstsc.exe", "mstsc",
]

RAT_TOOLS = [
    "njrat", "njrat.exe", "bladabindi", "nanocore", "asyncrat", "asyncrat.exe", "darkrat",
    "darkcomet", "quasar", "quasarrat", "quasar.exe", "xhacker", "xhackerrat", "orcus",
    "orcusrat", "venomrat", "cybergater", "adwind", "jrat", "limewire", "blackshades",
    "poisonivy", "hvnc", "vnc", "tightvnc", "ultravnc", "realvnc", "teamviewer", "anydesk",
    "ammyy", "logmein", "screenconnect", "supremo", "remoteutilities", "beacon",
    "beacon.exe", "trojan", "backdoor", "agenttesla", "formbook", "lokibot", "azorult",
    "vidar", "raccoon", "raccoonstealer",
]

RANSOMWARE = [
    "wannacry", "wanacry", "wana_decryptor", "badrabbit", "locky", "locker", "goldeneye",
    "notpetya", "petya", "mischa", "ryuk", "conti", "conti.exe", "revil", "sodinokibi",
    "darkside", "blackmatter", "hellokitty", "dearcry", "blackbasta", "royal", "play",
    "cryptolocker", "cryptowall", "cerber", "teslacrypt", "torrentlocker", "keRanger", "sam",
    "samas", "cryptXXX", "pcrypt", "jigsaw", "mole", "dmexe", "blc.exe", "encrypt.exe",
    "encryptor", "decrypt", "lockbit", "lockbit.exe",
]

EVASION_TOOLS = [
    "processhacker", "processhacker.exe", "procexp", "procexp.exe", "procmon.exe",
    "pchunter", "pchunter.exe", "powertool", "gmerexe", "gmerexe.exe", "rootkitrevealer",
    "hijackthis", "autoruns", "autoruns.exe", "tcpview", "tcpview.exe", "dbgview.exe",
    "x64dbg", "x32dbg", "ollydbg", "windbg", "ida", "idapro", "ghidra", "radare2", "rizin",
    "cheatengine", "cheatengine.exe", "scylla", "scylla.exe", "strongod", "protect",
    "protect.exe", "vmp", "vmprotect", "themida", "enigma", "asprotect", "upx", "packer",
    "packed", "crypted",
]

INFO_STEALERS = [
    "keylog", "keylogger", "keylogger.exe", "refog", "actualkeylogger", "bestfreakeylogger",
    "pykeylog", "logkeys", "uberkey", "spyrix", "microkeylogger", "kidlogger", "revealer",
    "keystroke", "keystrokelogger", "clipboard", "clipboardlogger", "clipper", "screenshot",
    "screencapture", "screenlogger", "formgrabber", "formstealer", "webinject", "redline",
    "redlinestealer",
]

ATTACK_TOOL_SETS = {
    "credential": CREDENTIAL_TOOLS,
    "scanner": SCANNER_TOOLS,
    "exploit": EXPLOIT_TOOLS,
    "post_exploit": POST_EXPLOIT_TOOLS,
    "rat": RAT_TOOLS,
    "ransomware": RANSOMWARE,
    "evasion": EVASION_TOOLS,
    "stealer": INFO_STEALERS,
}

# -- fixed values: other process-name lists ---------------------------------

LOLBINS = [
    "rundll32.exe", "regsvr32.exe", "mshta.exe", "certutil.exe", "bitsadmin.exe",
    "cscript.exe", "wscript.exe", "powershell.exe", "powershell", "pwsh.exe", "pwsh",
    "cmd.exe", "sh", "bash", "zsh", "wmic.exe", "mmc.exe", "msiexec.exe", "reg.exe",
    "schtasks.exe", "sc.exe", "net.exe", "net1.exe", "nslookup.exe", "arp.exe", "route.exe",
    "tracert.exe", "findstr.exe", "xcopy.exe", "robocopy.exe", "curl.exe", "curl", "wget",
    "wget.exe", "certreq.exe", "esentutl.exe", "expand.exe", "extract.exe", "makecab.exe",
    "pcalua.exe", "replace.exe", "syncappvpublishingserver.exe", "wevtutil.exe",
    "bcdedit.exe", "fsutil.exe",
]

LOLBIN_HOME_PATHS = ["\\system32\\", "\\syswow64\\", "/usr/bin/", "/bin/"]

SCRIPT_INTERPRETERS = [
    "powershell.exe", "powershell", "pwsh.exe", "pwsh", "cmd.exe", "cmd", "wscript.exe",
    "cscript.exe", "mshta.exe", "rundll32.exe", "bash", "sh", "zsh", "dash", "ksh", "tcsh",
    "python", "python.exe", "python3", "python3.exe", "perl", "perl.exe", "ruby",
    "ruby.exe", "php", "php.exe", "php-cgi.exe", "node", "node.exe", "nodejs", "nodejs.exe",
    "javaw", "javaw.exe", "java.exe", "java", "lua", "lua.exe", "tclsh", "autoit3.exe",
    "powershell_ise.exe", "powershell_ise",
]

DESKTOP_APPS = [
    "chrome.exe", "firefox.exe", "notepad.exe", "calc.exe", "wordpad.exe", "mspaint.exe",
    "winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "acrord32.exe",
    "acrord64.exe", "iexplore.exe", "msedge.exe", "opera.exe", "brave.exe", "spotify.exe",
    "discord.exe", "slack.exe", "teams.exe", "zoom.exe", "skype.exe", "thunderbird.exe",
]

PRIVILEGED_USERS = [
    "root", "system", "nt authority\\system", "administrator",
    "nt authority\\local service", "nt authority\\network service",
]

NETWORK_TOOLS = [
    "wireshark.exe", "wireshark", "tshark", "tcpdump", "dumpcap", "ethereal", "netstat",
    "arp.exe", "arp", "route.exe", "curl.exe", "curl", "wget", "wget.exe", "nc.exe",
    "ncat.exe", "ncat", "netcat", "socat", "telnet.exe", "telnet", "ftp.exe", "ftp",
    "ssh.exe", "ssh", "sshd", "sshd.exe", "nslookup.exe", "nslookup", "dig", "host",
    "ping.exe", "ping", "tracert.exe", "tracert", "pathping.exe", "mtr", "iperf", "iperf3",
    "httpie", "http", "aria2c", "aria2", "nmap", "nmap.exe", "masscan", "zmap", "rustscan",
    "naabu",
]

AUTORUN_LOOKALIKES = [
    "svch0st.exe", "scvhost.exe", "sysupdate.exe", "winupdate.exe", "microsofupdate.exe",
    "googledeupdate.exe", "adobeflashupdate.exe", "javupdate.exe", "mssecsvc.exe",
    "mssecsvc",
]

ALLOWED_UPDATERS = [
    "updater.exe", "update.exe", "chrome_updater.exe", "firefox_updater.exe",
    "msedge_updater.exe", "brave_updater.exe", "opera_autoupdate.exe", "sophosupdate.exe",
    "sophosupdater.exe",
]

# -- fixed values: path substrings ------------------------------------------

SUSPICIOUS_PATHS = [
    "\\temp\\", "\\tmp\\", "\\appdata\\local\\temp\\", "\\downloads\\", "\\desktop\\",
    "\\cache\\", "\\recycle.bin\\", "\\$recycle.bin\\", "\\programdata\\",
    "\\appdata\\roaming\\", "\\users\\public\\", "\\perflogs\\", "\\windows\\temp\\",
    "\\wINDOWS\\Temp\\", "\\system32\\tasks\\", "\\system32\\spool\\drivers\\",
    "\\system32\\spool\\servic\\", "/tmp/", "/var/tmp/", "/dev/shm/", "/var/cache/",
    "/var/spool/", "/var/www/", "/home/*/.cache/", "/home/*/.local/share/Trash/",
    "/run/user/", "/dev/pts/",
]

PERSISTENCE_PATHS = [
    "\\startup\\", "\\start menu\\programs\\startup\\", "\\system32\\tasks\\",
    "\\system32\\drivers\\etc\\", "\\windows\\system32\\tasks\\",
    "\\appdata\\roaming\\microsoft\\windows\\start menu\\programs\\startup\\",
    "/etc/init.d/", "/etc/systemd/system/", "/etc/cron.d/", "/etc/cron.hourly/",
    "/etc/cron.daily/", "/Library/LaunchAgents/", "/Library/LaunchDaemons/",
    "~/Library/LaunchAgents/",
]

# -- fixed values: patterns --------------------------------------------------

ENCODED_PATTERNS = [
    r"-(enc|encodedcommand|e)\s+[A-Za-z0-9+/]{20,}={0,2}",
    r"base64.+decode",
    r"frombase64string",
    r"-e\s+[A-Za-z0-9+/]{20,}={0,2}",
    r"iex\s*\(",
    r"invoke-expression",
    r"-ec\s+",
    r"frombase64",
    r"char\(\d+\)",
    r"\\x[0-9a-f]{2}",
]

DOUBLE_EXTENSION = (
    r"\.(pdf|doc|docx|xls|xlsx|jpg|png|txt|rtf|ppt|pptx)"
    r"\.(exe|bat|ps1|vbs|js|com|scr|pif|jar|wsf|hta)$"
)

PRIVATE_V4 = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|127\.|169\.254\.|0\.)"
PRIVATE_V6 = r"^(::1|fe80:|fc00:|fd00:|fec0:)"
INTERNAL_PREFIXES = ["10.", "192.168.", "172.16."]

IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
DOMAIN_PATTERN = r"\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}\b"
DOMAIN_SYNTAX = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"

PROMPT_PATTERNS = [
    r"ignore (all )?(previous|past)( instructions| messages| prompts| commands)?",
    r"forget (all )?(previous|past)( instructions| messages| prompts| commands)?",
    r"override (the )?(system|security|policy|filters)",
    r"disable (the )?(filters|safety|moderation)",
    r"jailbreak",
    r"break out of",
    r"do anything now",
    r"act as if",
    r"execute the following command",
]

# applied in this order
REDACTIONS = [
    (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[REDACTED_IP]"),
    (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "[REDACTED_EMAIL]"),
    (r"(?i)(password|passwd)\s*[:=]\s*[^\s,;]+", "[REDACTED]"),
    (r"(?i)(api[_-]?key|token|secret)\s*[:=]\s*[^\s,;]+", "[REDACTED_TOKEN]"),
    (r"(?i)\b[a-f0-9]{32,}\b", "[REDACTED_HEX]"),
]

# -- fixed values: process lineage ------------------------------------------
# (parent substrings, child substrings, severity, subject, tactic id, tactic,
#  technique, technique id); the first group that matches wins.

PARENT_CHILD_GROUPS = [
    (["winword.exe", "word.exe", "excel.exe", "powerpnt.exe", "outlook.exe"],
     ["powershell", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe",
      "sh", "bash", "python", "wmic.exe", "regsvr32.exe", "certutil.exe", "bitsadmin.exe"],
     "CRITICAL", "Office process spawning script interpreter",
     "TA0002", "Execution", "User Execution", "T1204"),
    (["chrome.exe", "msedge.exe", "firefox.exe", "opera.exe", "brave.exe", "iexplore.exe",
      "safari.exe", "safari"],
     ["powershell", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "sh", "bash",
      "python", "rundll32.exe"],
     "HIGH", "Browser spawning script interpreter",
     "TA0002", "Execution", "User Execution", "T1204"),
    (["acrord32.exe", "acrord64.exe", "pdf", "reader", "foxit"],
     ["powershell", "cmd.exe", "wscript.exe", "mshta.exe", "sh", "bash", "python"],
     "CRITICAL", "PDF reader spawning script interpreter",
     "TA0002", "Execution", "User Execution", "T1204"),
    (["outlook.exe", "thebat.exe", "thunderbird.exe", "mail"],
     ["powershell", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "sh", "bash"],
     "CRITICAL", "Email client spawning script interpreter",
     "TA0002", "Execution", "User Execution", "T1204"),
    (["svchost.exe", "services.exe", "lsass.exe", "wininit.exe", "system", "winlogon.exe"],
     ["powershell", "cmd.exe", "wscript.exe", "cscript.exe", "sh", "bash", "python"],
     "CRITICAL", "System process spawning script interpreter",
     "TA0004", "Privilege Escalation", "Process Injection", "T1055"),
    (["explorer.exe", "explorer"],
     ["powershell", "cmd.exe", "wscript.exe", "mshta.exe", "regsvr32.exe", "rundll32.exe",
      "certutil.exe"],
     "MEDIUM", "Explorer spawning LOLBin",
     "TA0005", "Defense Evasion", "Signed Binary Proxy Execution", "T1218"),
    (["notepad.exe", "wordpad.exe", "mspaint.exe", "calc.exe"],
     ["powershell", "cmd.exe", "sh", "bash"],
     "HIGH", "Utility process spawning script interpreter",
     "TA0002", "Execution", "User Execution", "T1204"),
]

# documents opened by these programs ...
DOCUMENT_PARENTS = [
    "winword.exe", "word.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "acrord32.exe",
    "acrord64.exe", "foxitreader.exe",
]
# ... starting one of these tools
DOCUMENT_CHILDREN = [
    "curl.exe", "curl", "wget.exe", "wget", "nc.exe", "ncat.exe", "powershell.exe",
    "powershell", "cmd.exe", "bitsadmin.exe",
]

# -- fixed values: malware family keywords ----------------------------------
# (keyword, severity, text before the name, tactic id, technique, technique id);
# the first keyword that matches wins.

MALWARE_FAMILIES = [
    ("lockbit", "HIGH", "Possible LockBit ransomware detected", "TA0040", "Impact", "T1486"),
    ("trojan", "HIGH", "Possible trojan detected", "TA0002", "Execution", "T1204"),
    ("backdoor", "HIGH", "Possible backdoor detected", "TA0002", "Execution", "T1204"),
    ("dropper", "HIGH", "Possible dropper detected", "TA0005", "Defense Evasion", "T1204"),
    ("downloader", "HIGH", "Possible downloader detected", "TA0011", "Command and Control", "T1105"),
    ("loader", "MEDIUM", "Possible loader detected", "TA0005", "Defense Evasion", "T1218"),
    ("worm", "MEDIUM", "Possible worm detected", "TA0008", "Lateral Movement", "T1210"),
    ("rootkit", "HIGH", "Possible rootkit detected", "TA0005", "Defense Evasion", "T1014"),
    ("spyware", "MEDIUM", "Possible spyware detected", "TA0009", "Collection", "T1056"),
    ("adware", "LOW", "Possible adware detected", "TA0009", "Collection", "T1056"),
    ("ransom", "HIGH", "Possible ransomware detected", "TA0040", "Impact", "T1486"),
    ("keylogger", "HIGH", "Keylogger detected", "TA0009", "Collection", "T1056"),
    ("miner", "MEDIUM", "Possible cryptocurrency miner", "TA0040", "Impact", "T1496"),
    ("coin", "MEDIUM", "Possible cryptocurrency mining process", "TA0040", "Impact", "T1496"),
    (" inject", "HIGH", "Possible process injection indicator", "TA0005", "Defense Evasion", "T1055"),
    ("injector", "HIGH", "Process injector detected", "TA0005", "Defense Evasion", "T1055"),
    ("steal", "HIGH", "Possible information stealer", "TA0009", "Collection", "T1056"),
    ("password", "MEDIUM", "Password-related process", "TA0006", "Credential Access", "T1003"),
]

# -- fixed values: thresholds and labels ------------------------------------

HIGH_THREAD_COUNT = 200
SEVERITY_WEIGHT = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
SYSLOG_LABELS = ["Emerg", "Alert", "Crit", "Error", "Warn", "Notice", "Info", "Debug"]
REPUTATION_LABELS = ["known", "suspicious", "malicious", "unknown"]
FAILED_LOGIN_PHRASES = ["failed password", "authentication failure"]

# -- fixed values: the static rules, in evaluation order --------------------
# (name, severity, tactic id, tactic, technique, technique id, what it finds)

STATIC_RULES = [
    ("Known Attack Tool", "CRITICAL", "TA0002", "Execution", "User Execution", "T1204",
     "process names of known attack tools, credential dumpers, scanners, RATs and ransomware"),
    ("Suspicious Parent-Child", "CRITICAL", "TA0002", "Execution", "User Execution", "T1204",
     "office, browser, reader and system programs that start script interpreters"),
    ("Malware Family", "HIGH", "TA0002", "Execution", "User Execution", "T1204",
     "process names holding a malware family keyword"),
    ("Suspicious Execution Path", "HIGH", "TA0002", "Execution",
     "Command and Scripting Interpreter", "T1059",
     "programs run from temporary, download, cache or public folders"),
    ("Privilege Escalation", "HIGH", "TA0004", "Privilege Escalation",
     "Access Token Manipulation", "T1134", "desktop programs run by a privileged account"),
    ("Double Extension", "HIGH", "TA0005", "Defense Evasion", "Masquerading", "T1036",
     "names with a document extension followed by a program extension"),
    ("Encoded Command", "HIGH", "TA0005", "Defense Evasion",
     "Obfuscated Files or Information", "T1027", "encoded or obfuscated command lines"),
    ("Persistence Path", "HIGH", "TA0003", "Persistence",
     "Boot or Logon Autostart Execution", "T1547", "programs in start-up, cron or service folders"),
    ("Script Interpreter Abuse", "MEDIUM", "TA0002", "Execution",
     "Command and Scripting Interpreter", "T1059", "script interpreters"),
    ("Network Tool in Suspicious Path", "MEDIUM", "TA0007", "Discovery",
     "System Network Configuration Discovery", "T1016",
     "network tools run from a suspicious folder"),
    ("DLL Hijacking", "HIGH", "TA0005", "Defense Evasion", "DLL Side-Loading", "T1574",
     "libraries loaded from a user-writable folder"),
    ("LOLBin Abuse", "HIGH", "TA0005", "Defense Evasion",
     "Signed Binary Proxy Execution", "T1218", "system binaries run from an unusual folder"),
    ("High Thread Count", "MEDIUM", "TA0005", "Defense Evasion", "Process Injection", "T1055",
     "processes with an abnormally high thread count"),
    ("Network Beacon", "MEDIUM", "TA0011", "Command and Control",
     "Application Layer Protocol", "T1071", "established connections to public addresses"),
    ("Persistence Autorun", "HIGH", "TA0003", "Persistence",
     "Boot or Logon Autostart Execution", "T1547", "names that imitate system or update programs"),
]


def attack_tools() -> list[str]:
    """Union of the tool categories, first occurrence order."""
    return list(dict.fromkeys(n for names in ATTACK_TOOL_SETS.values() for n in names))

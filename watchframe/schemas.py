"""Table schemas as DDL strings."""

CONNECTION = "struct<proto:string,local:string,remote:string,state:string>"
PROCESS = ("struct<name:string,process_name:string,path:string,process_path:string,pid:bigint,"
           "cpu_percent:double,cpu_usage:double,cpu:double,percent:double,memory_percent:double,"
           "ram_usage:double,mem_usage:double,ram:double,memory:double>")

# fixed values: event fields with their type and the longest text accepted
EVENT_FIELDS = {
    "agent_id": ("string", 64), "timestamp": ("timestamp", None), "event_type": ("string", 50),
    "hostname": ("string", 255), "ip_address": ("string", 45), "os": ("string", 50),
    "pid": ("bigint", None), "parent_pid": ("bigint", None),
    "parent_process_name": ("string", 255), "process_name": ("string", 255),
    "process_path": ("string", 1024), "user": ("string", 255), "file_hash": ("string", 64),
    "thread_count": ("int", None), "cpu_usage": ("double", None), "ram_usage": ("double", None),
    "disk_free": ("bigint", None), "disk_total": ("bigint", None),
    "network_sent": ("bigint", None), "network_received": ("bigint", None),
    "processes": (f"array<{PROCESS}>", 500), "users": ("array<map<string,string>>", None),
    "network_flows": ("array<map<string,string>>", None),
    "network_connections": (f"array<{CONNECTION}>", None),
    "message": ("string", None), "sender_id": ("string", None), "event_id": ("bigint", None),
}
REQUIRED = ["agent_id", "timestamp", "event_type"]

CUSTOM_RULES = ("id bigint, name string, target_field string, pattern string, severity string, "
                "is_active boolean, conditions string, whitelist string, auto_remediation string, "
                "mitre_tactic string, mitre_tactic_id string, mitre_technique string, "
                "mitre_technique_id string, trigger_count bigint, last_triggered timestamp, "
                "created_at timestamp")
PLAYBOOKS = ("id bigint, name string, is_active boolean, trigger_severity string, "
             "trigger_event_type string, trigger_process_name string")
PLAYBOOK_ACTIONS = ("id bigint, playbook_id bigint, action_type string, target string, "
                    "params string, `order` int")
OSINT_REPORTS = ("id bigint, query string, source string, data string, created_at timestamp, "
                 "cached_until timestamp")
IP_REPUTATIONS = ("ip_address string, label string, confidence int, source string, details string, "
                  "updated_at timestamp")
HOSTS = ("ip_address string, hostname string, mac_address string, vendor string, os_guess string, "
         "os_confidence int, status string, open_ports array<int>, source string, "
         "endpoint_status string, metrics_status string, first_seen timestamp, last_seen timestamp")
SYSLOG = ("facility int, severity int, hostname string, app_name string, message string, "
          "timestamp timestamp")


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p.title() for p in rest)

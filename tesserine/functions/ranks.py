"""Rank tables and state ladders as column expressions (§2.13, P1-P4, P12-P14, P17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
CONFIDENCE_RANK = {"UNKNOWN": -1, "LOW": 0, "MEDIUM": 1, "HIGH": 2, "EXACT": 3}
SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERITY_SCORE = {"info": 10, "low": 30, "medium": 55, "high": 80, "critical": 95}
CONFIDENCE_SCORE = {"low": 30, "medium": 60, "high": 85, "confirmed": 95}
PROVIDERS = ("nvd", "ghsa", "osv", "import", "test", "local", "bundle")
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "MODERATE": 2, "LOW": 1, "NONE": 0}
#: The platform's runtime permissions, by group.
DANGEROUS_GROUPS = {
    "CALENDAR": ("READ_CALENDAR", "WRITE_CALENDAR"),
    "CALL_LOG": ("READ_CALL_LOG", "WRITE_CALL_LOG", "PROCESS_OUTGOING_CALLS"),
    "CAMERA": ("CAMERA",),
    "CONTACTS": ("READ_CONTACTS", "WRITE_CONTACTS", "GET_ACCOUNTS"),
    "LOCATION": ("ACCESS_FINE_LOCATION", "ACCESS_COARSE_LOCATION", "ACCESS_BACKGROUND_LOCATION"),
    "MICROPHONE": ("RECORD_AUDIO",),
    "PHONE": ("READ_PHONE_STATE", "READ_PHONE_NUMBERS", "CALL_PHONE", "ANSWER_PHONE_CALLS", "ADD_VOICEMAIL", "USE_SIP", "ACCEPT_HANDOVER"),
    "SENSORS": ("BODY_SENSORS", "BODY_SENSORS_BACKGROUND"),
    "SMS": ("SEND_SMS", "RECEIVE_SMS", "READ_SMS", "RECEIVE_WAP_PUSH", "RECEIVE_MMS"),
    "STORAGE": ("READ_EXTERNAL_STORAGE", "WRITE_EXTERNAL_STORAGE", "ACCESS_MEDIA_LOCATION"),
    "ACTIVITY_RECOGNITION": ("ACTIVITY_RECOGNITION",),
    "NEARBY_DEVICES": ("BLUETOOTH_SCAN", "BLUETOOTH_ADVERTISE", "BLUETOOTH_CONNECT", "NEARBY_WIFI_DEVICES", "UWB_RANGING"),
    "NOTIFICATIONS": ("POST_NOTIFICATIONS",),
    "MEDIA": ("READ_MEDIA_IMAGES", "READ_MEDIA_VIDEO", "READ_MEDIA_AUDIO", "READ_MEDIA_VISUAL_USER_SELECTED"),
}
#: The platform's signature permissions.
SIGNATURE = (
    "INSTALL_PACKAGES", "DELETE_PACKAGES", "WRITE_SECURE_SETTINGS", "MOUNT_UNMOUNT_FILESYSTEMS", "READ_LOGS", "SET_TIME", "REBOOT", "MANAGE_DEVICE_ADMINS",
    "BIND_DEVICE_ADMIN", "BIND_ACCESSIBILITY_SERVICE", "BIND_NOTIFICATION_LISTENER_SERVICE", "CAPTURE_AUDIO_OUTPUT", "CONTROL_LOCATION_UPDATES",
    "FACTORY_TEST", "MANAGE_EXTERNAL_STORAGE", "MODIFY_PHONE_STATE",
)
DANGEROUS = tuple(name for names in DANGEROUS_GROUPS.values() for name in names)
PERMISSION_GROUP = {name: group for group, names in DANGEROUS_GROUPS.items() for name in names}


def ranked(c: Column, table: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, rank in table.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def ranked_sql(c: str, table: dict[str, int], other: int) -> str:
    return f"CASE {c} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in table.items())} ELSE {other} END"


def exposure(exported: Column, has_filter: Column, kind: Column) -> Column:
    """What a component's manifest says about who can reach it."""
    return (
        F.when(exported, "EXPORTED").when(~exported, "INTERNAL").when(has_filter & (kind != "provider"), "CONDITIONALLY_EXPORTED").when(kind == "provider", "UNKNOWN").otherwise("INTERNAL")
    )


def surface_exposure(exposure_state: Column, permission: Column) -> Column:
    """The attack surface's view; an empty permission is none."""
    exported = exposure_state.isin("EXPORTED", "CONDITIONALLY_EXPORTED")
    return F.when(exposure_state == "UNKNOWN", "UNKNOWN").when(~exported, "INTERNAL").when(F.coalesce(permission, F.lit("")) != "", "PERMISSION_PROTECTED").otherwise("PUBLIC")


def permission_class(name: Column) -> Column:
    """P2."""
    short = F.regexp_replace(name, r"^android\.permission\.", "")
    return F.when(~name.startswith("android.permission."), "UNKNOWN").when(short.isin(*DANGEROUS), "DANGEROUS").when(short.isin(*SIGNATURE), "SIGNATURE").otherwise("NORMAL")


def permission_group(name: Column) -> Column:
    """The group of a runtime permission, else null."""
    groups = F.create_map(*(F.lit(x) for pair in PERMISSION_GROUP.items() for x in pair))
    return F.when(permission_class(name) == "DANGEROUS", groups[F.regexp_replace(name, r"^android\.permission\.", "")])


def cvss_band(score: Column) -> Column:
    """P14."""
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score > 0, "LOW").when(score == 0, "NONE")


def risk_band(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 70, "high").when(score >= 40, "medium").when(score >= 20, "low").otherwise("info")


#: P12. The first entry whose field holds one of the words decides.
OBSERVED = (
    ("key", ("webview",), "WEBVIEW_NAVIGATION"),
    ("key", ("class.forname", "method.invoke", "reflect"), "REFLECTION_RESOLUTION"),
    ("key", ("classloader", "loadlibrary", "loadclass"), "DYNAMIC_CLASS_LOADING"),
    ("key", ("sslcontext", "ssl", "trustmanager", "x509"), "TLS_NETWORK"),
    ("key", ("messagedigest", "cipher", "mac.getinstance", "keystore"), "SECURITY_SENSITIVE_CONFIG"),
    ("method", ("onbind", "ontransact"), "BINDER_TRANSACTION"),
    ("key", ("binder",), "BINDER_TRANSACTION"),
    ("key", ("getdata", "getqueryparameter"), "DEEP_LINK_DISPATCH"),
    ("class", ("uri",), "DEEP_LINK_DISPATCH"),
    ("key", ("getaction", "getextra", "getstringextra"), "INTENT_METADATA"),
    ("class", ("intent",), "INTENT_METADATA"),
    ("key", ("contentprovider", ".query", ".insert"), "CONTENT_PROVIDER_ACCESS"),
)
LIFECYCLE = ("onCreate", "onResume", "onNewIntent", "onStart", "onPause")
OBSERVED_LATE = (
    ("class", ("service",), "SERVICE_START"),
    ("class", ("broadcast",), "BROADCAST_DISPATCH"),
    ("method", ("onreceive",), "BROADCAST_DISPATCH"),
    ("key", ("fileinputstream", "fileoutputstream"), "FILESYSTEM_ACCESS"),
    ("class", ("file",), "FILESYSTEM_ACCESS"),
)


def observed_kind(kind: Column, class_name: Column, method_name: Column, symbol: Column) -> Column:
    cls, method = F.coalesce(class_name, F.lit("")), F.coalesce(method_name, F.lit(""))
    fields = {"key": F.lower(F.concat(cls, F.lit("."), method)), "class": F.lower(cls), "method": F.lower(method)}
    sym = F.lower(F.coalesce(symbol, F.lit("")))
    native = F.when(sym.isin("jni_onload", "jni_onunload", "registernatives") | sym.startswith("java_"), "JNI_INVOCATION").otherwise("NATIVE_API_INVOCATION")
    out = F.when(F.upper(kind) == "PROCESS", "PROCESS_LIFECYCLE").when((kind == "NATIVE") | (sym != ""), native)
    holds = lambda field, words: F.lit(False) if not words else holds(field, words[1:]) | fields[field].contains(words[0])
    for field, words, name in OBSERVED:
        out = out.when(holds(field, words), name)
    out = out.when(method.isin(*LIFECYCLE), F.when(fields["class"].contains("activity"), "ACTIVITY_LAUNCH").otherwise("COMPONENT_DISPATCH"))
    for field, words, name in OBSERVED_LATE:
        out = out.when(holds(field, words), name)
    return out.otherwise("RUNTIME_BEHAVIOR")


def observed_kind_sql() -> str:
    field = {"key": "lower(class_name || '.' || method_name)", "class": "lower(class_name)", "method": "lower(method_name)"}
    test = lambda f, words: " OR ".join(f"contains({field[f]}, '{w}')" for w in words)
    early = " ".join(f"WHEN {test(f, w)} THEN '{n}'" for f, w, n in OBSERVED)
    late = " ".join(f"WHEN {test(f, w)} THEN '{n}'" for f, w, n in OBSERVED_LATE)
    methods = ", ".join(f"'{m}'" for m in LIFECYCLE)
    return f"""CASE WHEN observation_type = 'PROCESS' THEN 'PROCESS_LIFECYCLE' WHEN observation_type = 'NATIVE' OR coalesce(symbol, '') <> '' THEN
      CASE WHEN lower(symbol) IN ('jni_onload', 'jni_onunload', 'registernatives') OR lower(symbol) LIKE 'java\\_%' ESCAPE '\\' THEN 'JNI_INVOCATION' ELSE 'NATIVE_API_INVOCATION' END
      {early} WHEN method_name IN ({methods}) THEN CASE WHEN contains(lower(class_name), 'activity') THEN 'ACTIVITY_LAUNCH' ELSE 'COMPONENT_DISPATCH' END {late} ELSE 'RUNTIME_BEHAVIOR' END"""

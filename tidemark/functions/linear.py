"""Equivalent forms of rules whose search is not linear in a backtracking engine.

A rule such as ``//.*(key).*[:=]value`` is retried, on a long line, from every
``//`` and, from each, for every keyword. Here such rules get two patterns:

* ``main`` finds the same matches; its choices are atomic where the first
  choice decides whether a later one can succeed.
* ``skip`` is tried where ``main`` fails: it takes the rest of the stretch (a
  line, a bracket, a quoted text) in which ``main`` cannot succeed from any
  later start either, since everything it needs lies in the same stretch. What
  ``skip`` took is no match; it is dropped after the search.

So a stretch is read a bounded number of times however many starts it holds.
The equivalence to the published text is tested rule by rule.
"""
from __future__ import annotations

#: rule name -> (main, skip), in the dialect of the published rules
LINEAR: dict[str, tuple[str, str]] = {
    "Google Service Account": (
        r'(?i)(?:service[_\-\s]?account)[^"]*?(?:\.json|private_key)',
        r'(?i)service[_\-\s]?account[^"]*+'),
    "SQL Server Connection": (
        r'(?i)(?:server|data source)=[^;]+;(?:uid|user id)=[^;]+;(?:pwd|password)=([^;]+)',
        r'(?i)(?:server|data source)=[^;]++'),
    "Kubernetes Config": (
        r'(?i)kubeconfig|kubectl[^"]*?(?:token|certificate)',
        r'(?i)kubectl(?:(?!kubeconfig)[^"])*+'),
    "JS Config Object": (
        r'(?:config|settings|options)\s*=\s*\{(?>[^}]*?(?:key|token|secret|password))[^}]*\}',
        r'(?:config|settings|options)\s*=\s*\{[^}]*+'),
    "JS Fetch with Auth": (
        r'fetch\((?>[^)]+?headers)(?>[^)]*?(?:Authorization|authorization))[^)]+\)',
        r'fetch\([^)]*+'),
    "JS Comments with Secrets": (
        r'//(?>.*?(?:token|password|key|secret|api)).*[:=]\s*["\']?([a-zA-Z0-9_\-]{10,})',
        r'//.*+'),
    # a ``from`` at the end of its line, its quote on the next, comes first, as the greedy form finds it
    "JS Import Secret": (
        r'import\s+(?:.*from[^\S\n]*\n\s*["\'](?>.*?(?:config|secret|key|token)).*["\']'
        r'|(?>.*?from[^\S\n]+["\'])(?>.*?(?:config|secret|key|token)).*["\'])',
        r'import\s+(?:.*(?=import\s*$)|.*+)'),
    "JS Require Secret": (
        r'require\(["\'](?>.*?(?:config|secret|key|token)).*["\']\)',
        r'require\(["\'].*+'),
    "JS Axios Auth": (
        r'axios\.(?:get|post|put|delete)\((?>[^)]+?(?:headers|auth))[^)]+\)',
        r'axios\.(?:get|post|put|delete)\([^)]*+'),
    "JS Hardcoded URL with Key": (
        r'(?:http|https)://[^"\s]*[?&](?:api[_\-]?key|token|auth)=[^&"\s]+',
        r'(?:http|https)://[^"\s]*+'),
    "SQL Injection Point": (
        r'(?i)(?:select|insert|update|delete|union|from|where).*(?:\$_GET|\$_POST|\$_REQUEST)',
        r'(?i)(?:select|insert|update|delete|union|from|where).*+'),
    "XSS Vulnerable": (
        r'(?i)(?:document\.write|innerHTML|eval)\s*\([^)]*(?:\$_GET|\$_POST|location\.)',
        r'(?i)(?:document\.write|innerHTML|eval)\s*\([^)]*+'),
    # a run of 64 characters and more is read once; shorter ones cost little
    "Email Address": (
        r'(?=[A-Za-z0-9._%+-]++@)\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b',
        r'(?=[A-Za-z0-9._%+-]{64})(?:[A-Za-z0-9._%+-]{64,}+(?!@)|\b[A-Za-z0-9._%+-]{64,}+@)'),
    # all starts with a colon before the next @ share what follows it
    "Elasticsearch URL": (
        r'(?:http|https)://[^:]+:[^@]+@[^/]+:[0-9]+',
        r'(?:http|https)://(?:[^@]*:(?!//))?+'),
}

#: rule name -> what stands at the start of every match: a cheap look ahead that
#: spares the look-behinds, groups and alternatives of the rule at most places
LEADS: dict[str, str] = {
    "Generic API Key": r'(?=api)',
    "AWS Access Key ID": r'(?=A)',
    "Google OAuth": r'(?=[gdy])',
    "Azure Subscription Key": r'(?=[am])',
    "Azure Storage Key": r'(?=[as])',
    "GitHub Token": r'(?=gh)',
    "Discord Token": r'(?=[dMN])(?=[MN][a-zA-Z0-9]{23}\.|discord)',
    "Mailchimp API Key": r'(?=[a-z0-9]{32}-)',
    "Database Password": r'(?=d)',
    "Connection String with Password": r'(?=p)',
    "SQL Server Connection": r'(?=[sd])',
    "Credit Card Generic": r'(?=\d)',
    "CVV Code": r'(?=cv)',
    "SSN": r'(?=\d{3}-)',
    "IBAN": r'(?=[A-Z][A-Z][0-9])',
    "Bitcoin Address": r'(?=[13])',
    "Bitcoin Private Key": r'(?=[5KL][1-9A-HJ-NP-Za-km-z]{50})',
    "Bank Account Number": r'(?=\d{8})',
    "SWIFT Code": r'(?=[A-Z][A-Z][A-Z][A-Z][A-Z][A-Z])',
    "Routing Number": r'(?=[ar])',
    "Phone Number US": r'(?=[+(\d])',
    "Password in Text": r'(?=p)',
    "Username Field": r'(?=[ule])',
    "Private IP Address": r'(?=1)',
    "MAC Address": r'(?=[0-9a-fA-F][0-9a-fA-F][:-])',
    "Base64 Encoded Data": r'(?=[A-Za-z0-9+/]{40})',
    "Hash MD5": r'(?=[a-fA-F0-9]{32})',
    "Hash SHA1": r'(?=[a-fA-F0-9]{40})',
    "Hash SHA256": r'(?=[a-fA-F0-9]{64})',
    "Private Key Reference": r'(?=[ps])',
    "JS API Variable": r'(?=[vlc])',
    "JS Token Variable": r'(?=[vlc])',
    "JS Config Object": r'(?=[cso])',
    "SQL Injection Point": r'(?=[siudfw])',
    "XSS Vulnerable": r'(?=[die])',
    "Command Injection": r'(?=[espc])',
    "Stack Trace Exposed": r'(?=[est])',
    "TODO Comments": r'(?=[tfhxb])',
    "S3 Bucket Name": r'(?=s3)',
    "CDN URL": r'(?=[casm])',
    "Google Service Account": r'(?=s)',
    "Google Cloud Platform API": r'(?=g)',
    "Elasticsearch URL": r'(?=h)',
    "Kubernetes Config": r'(?=k)',
    "Email Address": r'(?=[A-Za-z0-9._%+-])',
    "JS Fetch with Auth": r'(?=f)',
    "JS Comments with Secrets": r'(?=//)',
    "JS Import Secret": r'(?=i)',
    "JS Require Secret": r'(?=r)',
    "JS Axios Auth": r'(?=a)',
    "JS Hardcoded URL with Key": r'(?=h)',
}

#: shapes that every match of several rules holds: looked for once a text
SHAPES: dict[str, str] = {
    "digits": r'[0-9](?:[\x09-\x0d .()-]*+[0-9]){7}',
    "run": r'[A-Za-z0-9_+/-]{24}',
}
SHAPE_OF: dict[str, str] = {name: shape for shape, names in {
    "digits": ["Credit Card Visa", "Credit Card MasterCard", "Credit Card Amex", "Credit Card Discover", "Credit Card Generic", "SSN",
               "Bank Account Number", "Phone Number US"],
    "run": ["Discord Token", "Telegram Bot Token", "Twilio API Key", "Twilio Account SID", "Mailchimp API Key", "Azure Storage Key",
            "Bitcoin Address", "Bitcoin Private Key", "Base64 Encoded Data", "Hash MD5", "Hash SHA1", "Hash SHA256", "UUID"],
}.items() for name in names}

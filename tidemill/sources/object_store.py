"""S3-compatible storage through the Hadoop ``s3a`` connector."""

from __future__ import annotations

from tidemill.specs import ObjectStore

# Credential provider classes of the Hadoop S3A connector and the AWS SDK.
_EXPLICIT = "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider"
_TEMPORARY = "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"
_CHAIN = "software.amazon.awssdk.auth.credentials.DefaultCredentialsProvider"


def bucket_root(store: ObjectStore) -> str:
    return f"s3a://{store.bucket}"


def s3a_options(store: ObjectStore) -> dict[str, str]:
    """Reader options for one bucket; scoped to it, so several stores can be read side by side."""
    options = {
        "endpoint.region": store.region,
        "path.style.access": str(store.path_style_access).lower(),
    }
    if store.endpoint_url:
        scheme, _, host = store.endpoint_url.rpartition("://")
        options["endpoint"] = host
        options["connection.ssl.enabled"] = str(scheme != "http").lower()
    if store.auth_method == "credential_chain":
        options["aws.credentials.provider"] = _CHAIN
    else:
        options["access.key"] = store.access_key_id
        options["secret.key"] = store.secret_access_key
        options["aws.credentials.provider"] = _EXPLICIT
        if store.session_token:
            options["session.token"] = store.session_token
            options["aws.credentials.provider"] = _TEMPORARY
    return {f"fs.s3a.bucket.{store.bucket}.{key}": value for key, value in options.items()}


def session_conf(store: ObjectStore) -> dict[str, str]:
    """The same as session settings, for tables that are stored in the bucket."""
    return {f"spark.hadoop.{key}": value for key, value in s3a_options(store).items()}

"""Raw records in the four source formats, written from the activity table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USER = "concat('user', user_id)"
ADDRESS = "concat('10.', user_id % 250, '.0.', k)"
STAMP = "concat(date_format(t, 'MMM'), ' ', lpad(day(t), 2, ' '), ' ', date_format(t, 'HH:mm:ss'))"
HOST = "concat('host-', user_id % 3)"
LOGIN = f"{USER}, ' from ', {ADDRESS}, ' port ', 1024 + k, ' ssh2'"


def _lines(acts: DataFrame, expression: str) -> DataFrame:
    timed = acts.withColumn("t", F.timestamp_seconds(F.expr("raw_us div 1000000")))
    return timed.select(F.col("event_id").cast("string").alias("line_id"), F.expr(expression).alias("raw"))


def syslog_lines(acts: DataFrame) -> DataFrame:
    return _lines(acts, f"""case event_type
        when 'error' then concat({STAMP}, ' ', {HOST}, ' sshd[', k, ']: Failed password for ',
            case when k % 3 = 0 then 'invalid user ' else '' end, {LOGIN})
        when 'signup' then concat({STAMP}, ' ', {HOST}, ' sshd[', k, ']: Accepted ',
            case when k % 2 = 0 then 'publickey' else 'password' end, ' for ', {LOGIN})
        when 'click' then concat({STAMP}, ' ', {HOST}, ' kernel: [', k, '.789] eth0: link up')
        when 'view' then concat('<134>1 ', date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), '+02:00 web-', k,
            ' app ', k, ' - - Accepted password for ', {LOGIN})
        else concat('  free text ', k, repeat(' x', 600)) end""")


def auth_lines(acts: DataFrame) -> DataFrame:
    head = f"{STAMP}, ' ', {HOST}"
    return _lines(acts, f"""case event_id % 9
        when 0 then concat({head}, ' sshd[1]: Failed password for ', {LOGIN})
        when 1 then concat({head}, ' sshd[1]: Accepted password for ', {LOGIN})
        when 2 then concat({head}, ' sshd[1]: Invalid user ', {USER}, ' from ', {ADDRESS}, ' port 22')
        when 3 then concat({head}, ' sudo[7]: ', {USER},
            ' : TTY=pts/0 ; PWD=/home/x ; USER=root ; COMMAND=/usr/bin/id ', k)
        when 4 then concat({head}, ' su: pam_unix(su', case when k % 2 = 0 then '-l' else '' end,
            ':session): session ', case when k % 3 = 0 then 'closed' else 'opened' end, ' for user ', {USER}, ' by x')
        when 5 then concat({head}, ' sshd[3]: pam_unix(sshd:auth): authentication failure; logname= uid=0 rhost=',
            {ADDRESS}, ' user=', {USER})
        when 6 then concat({head}, ' cron[9]: pam_unix(cron:session): session opened for user ', {USER})
        when 7 then concat({head}, ' systemd: Started unit ', k)
        else concat('no header at all ', k) end""")


EVENT_NAME = ("element_at(array('ConsoleLogin','CreateUser','DeleteUser','AttachUserPolicy','CreateAccessKey',"
              "'AuthorizeSecurityGroupIngress','RunInstances','StopInstances','GetObject','PutObject','AssumeRole',"
              "'ListBuckets'), 1 + k % 12)")


def cloud_lines(acts: DataFrame) -> DataFrame:
    return _lines(acts, f"""case when event_type = 'purchase' and k % 10 = 0 then concat('{{"eventName": "', k)
        else to_json(named_struct(
            'eventTime', concat(date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), 'Z'),
            'eventSource', case when k % 5 > 0 then concat('svc', k % 5, '.amazonaws.com') end,
            'eventName', case when k < 97 then {EVENT_NAME} end,
            'sourceIPAddress', {ADDRESS},
            'userIdentity', case when user_id % 4 < 3 then named_struct('type', 'IAMUser',
                'userName', case when user_id % 3 = 0 then {USER} end,
                'principalId', case when user_id % 3 < 2 then concat('P', user_id) end,
                'arn', concat('arn:', user_id), 'accountId', '42') end,
            'responseElements', case when event_type = 'click' then
                map('ConsoleLogin', case when k % 24 = 0 then 'Failure' else 'Success' end) end,
            'errorCode', case when event_type = 'error' then 'AccessDenied' end)) end""")


LABEL = ("element_at(array('BENIGN','FTP-Patator','SSH-Patator','DoS slowloris','DoS Slowhttptest','DoS Hulk',"
         "'DoS GoldenEye','Heartbleed','Web Attack – Brute Force','Web Attack – XSS','Web Attack – Sql Injection',"
         "'Infiltration','Bot','PortScan','DDoS','SomeNewAttackType','Odd Label'), 1 + k % 17)")


def flow_rows(acts: DataFrame) -> DataFrame:
    """Flow CSV columns, all text, with the padded header names of the public data set."""
    timed = acts.withColumn("t", F.timestamp_seconds(F.expr("raw_us div 1000000")))
    e = F.expr
    columns = {
        " Source IP": f"concat(' ', {ADDRESS})",
        " Destination IP": "case when k % 7 = 0 then '' else concat('192.168.0.', k) end",
        " Source Port": "concat(1024 + k, '.7')",
        " Destination Port": "case when k % 10 = 6 then '0' else cast(k as string) end",
        " Timestamp": "case event_id % 4 when 0 then date_format(t, 'dd/MM/yyyy HH:mm:ss') "
                      "when 1 then date_format(t, 'd/M/yyyy HH:mm') when 2 then date_format(t, 'yyyy-MM-dd HH:mm:ss') "
                      "else date_format(t, 'MM/dd/yyyy HH:mm') end",
        " Flow Duration": "cast(user_id as string)",
        " Total Fwd Packets": "cast(k as string)",
        " Total Backward Packets": "case when k % 13 = 0 then 'Infinity' else cast(k div 2 as string) end",
        "Flow Bytes/s": "case k % 11 when 0 then 'Infinity' when 1 then 'NaN' when 2 then 'junk' "
                        "else cast(value as string) end",
        "Flow Packets/s": "'2.5'",
        " Label": f"concat(' ', {LABEL})",
    }
    return timed.select(F.col("event_id").cast("string").alias("line_id"),
                        *[e(x).alias(name) for name, x in columns.items()])

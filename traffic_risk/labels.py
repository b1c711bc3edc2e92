"""Label strings of the output tables.

Fixed values: these strings are the output contract, and the user-day roll-up
of the cohort report takes a string maximum over them, so their order matters.
"""

GROUP_A = "A_双模型一致高危"
GROUP_B = "B_XGB高置信新增"
GROUP_C = "C_XGB中高置信新增"
GROUP_D = "D_XGB边界风险"
GROUP_E = "E_IForest独有异常"
GROUP_F = "F_双模型正常"
GROUP_UNKNOWN = "UNKNOWN"
UNMATCHED = "未匹配模型结果"

ACTION_BLOCK_A = "直接拦截/强风险"
ACTION_BLOCK_B = "直接拦截/XGB高置信新增"
ACTION_REVIEW_B = "高优先级审核"
ACTION_SAMPLE_C = "观察池/抽样审核"
ACTION_TAG_D = "仅打标签，不拦截"
ACTION_RECHECK_E = "分歧样本复查"
ACTION_PASS_F = "放行"

POOL_BLOCKED = "直接拦截"
POOL_AUDIT = "人工审核池"
POOL_OBSERVE = "观察/复查池"
POOL_PASS = "放行"
NOT_BLOCKED = "未直接拦截"

AUDIT_GROUPS = (GROUP_B, GROUP_C)
OBSERVE_GROUPS = (GROUP_D, GROUP_E)

UNKNOWN_TEXT = "未知"
FIRST_DAY = "首日登录"
NOT_FIRST_DAY = "非首日登录"
STAGE_BEFORE = "剔除前"
STAGE_AFTER = "剔除后"
REMAINDER = "其他"

OTHER_RESOLUTION = "__OTHER_RESOLUTION__"
"""Bucket of valid but rare screen resolutions."""

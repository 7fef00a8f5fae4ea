"""Fields of a manifest and what they may say."""

REQUIRED = ("id", "path", "ai_status", "use")
KNOWN = """
id path project_area author persona register genre date_written ai_status editing_status word_count use split privacy source notes
language_status adversarial_class source_id source_family transform pov tags corpus_role impostor_for register_match topic_match consent_status
era acquired_via content_hash topic passage_dedup
""".split()
ALLOWED = {
    "ai_status": "pre_ai_human ai_generated ai_assisted ai_edited mixed unknown ai_generated_from_outline".split(),
    "register": """
literary_fiction blog_essay academic_philosophy testimony_policy personal policy_advocacy literary_horror policy_brief scholarly_article legal_brief
grant_proposal expert_affidavit regulatory_comment professional_letter teaching message.imessage message.facebook_messenger social_media_twitter
forum_metafilter social_media_facebook_posts social_media_facebook_comments
""".split(),
    "split": "baseline train test holdout".split(),
    "privacy": "private shareable public_domain".split(),
    "editing_status": "raw_draft revised_human published_cleaned coauthored".split(),
    "language_status": "native non_native_advanced non_native_intermediate learner unknown".split(),
    "corpus_role": "identity_baseline impostor distractor adversarial".split(),
    "register_match": "high medium low".split(),
    "topic_match": "high medium low".split(),
    "consent_status": "public_record cc_licensed fair_use_research author_consent undocumented".split(),
    "era": "pre_chatgpt pre_ai_widespread post_ai_widespread undated".split(),
}
SOURCE_FAMILY = "facebook metafilter wordpress unclassified".split()
USE = "baseline validation voice_validation voice_profile voice_impostor idiolect negative_baseline exclude".split()
RETIRED_REGISTERS = ["social_media_facebook"]
PROFILE_ONLY_REGISTERS = ["message.imessage", "message.facebook_messenger"]
#: Copies that synchronisation leaves behind when two sides have changed.
CONFLICT_NAME = r"(?i)( \([^)]*conflicted copy[^)]*\)|\.sync-conflict-[0-9]{8}-[0-9]{6}.*| \([0-9]+\))(\.[a-z0-9]+)?$"
